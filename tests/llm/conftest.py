import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or longer tuples, with columns whose names operators use inside."""
    def make(rows):
        full = [(tuple(r) + (None, None, None))[:5] for r in rows]
        extra = "size long, key string, row long, print long, place long, epoch long, row_number long, text_key long"
        return spark.createDataFrame([r + (1, "k", 2, 3, 4, 5, 6, 7) for r in full], f"{DOCS}, {extra}")

    return make


class Union:
    """Union-find for brute-force checks."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture
def union():
    return Union
