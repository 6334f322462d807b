import pytest


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with an extra column of a name that operators use themselves."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", len(t or ""), i) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long")

    return make
