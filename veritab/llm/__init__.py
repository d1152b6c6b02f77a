"""Operators of a training-data pipeline over text corpora (documents, pages,
conversations). Nothing else in ``veritab`` imports this subpackage."""
