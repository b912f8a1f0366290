"""DataFrame -> DataFrame operators of the evaluation pipeline."""
