"""Operations that large-scale training-data pipelines need; nothing outside this package imports it."""
