"""DataFrame -> DataFrame steps and MLlib estimators."""
