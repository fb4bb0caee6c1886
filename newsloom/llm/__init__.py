"""Training-data operators: search, filtering, language models, packing, archives, joins.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries
and ``__spark_entry__`` adds them only when the subpackage is present.
"""
