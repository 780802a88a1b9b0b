"""editpairs: Spark jobs that curate image-edit pairs and training text."""
