"""Operations of a training-data pipeline: ten operators and their queries. Nothing else in the library imports this subpackage."""
