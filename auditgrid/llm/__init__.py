"""Operations of a training-data pipeline, each a function from DataFrame to DataFrame."""
