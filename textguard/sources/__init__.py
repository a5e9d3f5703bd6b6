"""Reading, schema detection, label normalisation, writing, caching and the model registry."""
