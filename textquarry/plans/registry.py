"""All queries of the package, without those of the llm subpackage."""

from . import corpus, dense, retrieval, training

ALL = {**corpus.Q, **retrieval.Q, **dense.Q, **training.Q}
QUERIES = {name: f for name, (f, _) in ALL.items()}
SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
