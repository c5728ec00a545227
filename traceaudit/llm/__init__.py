"""Operations of a training-data pipeline on corpora of documents; nothing else in the package imports this one."""
