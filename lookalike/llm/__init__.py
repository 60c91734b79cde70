"""Operations of a training-data pipeline: ten operators over documents, pages and embeddings.

Nothing outside this folder imports it.  ``queries`` registers one query per operator.
"""
