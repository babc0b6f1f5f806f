"""Training-data operators: ten Spark jobs over documents, pages and embeddings.

Nothing outside this subpackage imports it; ``queries.py`` holds its thin
``opN_<name>`` queries and ``oracles.py`` the SQL for those SQL can express.
"""
