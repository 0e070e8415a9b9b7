import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, score double, size int, label string, bucket long, ids string, copies string"


def edge_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, and ties."""
    texts = [
        None, "", " \n\t ", "one", "a b c d", "a b c d e", "a b c d e", "x " * 60_000, "ü" * 5_000,
        "the quick brown fox jumps over the lazy dog and runs away from the old farm house " * 3,
    ]
    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), "h", 0.5, 3, "l", 1, "i", "c") for k, t in enumerate(texts)]
    rows.append((None,) * 12)
    rows.append((50, "text of a null source and language", None, None, None, None, None, None, None, None, None, None))
    rows += [rows[9], rows[9], rows[9]]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Write named tables to a folder that queries can read."""

    def write(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
