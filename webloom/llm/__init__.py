"""Operations of a training-data pipeline. Nothing else in webloom imports this subpackage."""
