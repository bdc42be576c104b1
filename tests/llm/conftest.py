import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from learnlens.llm.shared import Scratch  # noqa: E402

SMALL = "/root/testdata/sf0.001"

# every awkward text: null, empty, blanks, ties, repeats, other scripts, control characters
TEXTS = [
    None,
    "",
    " ",
    "one",
    "One two three",
    "one two three",
    "the cat sat on the mat and the dog lay by the door of the house",
    "the cat sat on the mat and the dog lay by the door of the house",
    "a  b\n\n c \t d\r\n",
    " \n lead and trail \n ",
    "a line that is long enough\nanother line that is long enough\na line that is long enough",
    "A LINE that is long enough  \nown text of this one",
    "it's  'S <|endoftext|> x<|endoftext|> ▁▁ y ▁z",
    "é ́ x ΑΣ Σ 日本語 テキスト \xa0 a\x85 b c \x1c d \x00",
    "word " * 3000,
    "x" * 5000,
    "\n".join(f"line number {i} of a long text" for i in range(400)),
]


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return {r["doc_id"]: r["text"] for r in small.collect()}


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward texts, a null id, a repeated row, and columns whose names operators use inside."""
    rows = [(i, t, "en", "s", 7, "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "a text without an id, long enough", None, None, None, None), rows[6], rows[0]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, owner string"
    )


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
