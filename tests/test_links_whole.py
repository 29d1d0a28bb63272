"""Links between pages are found for every page of the table."""

import pyarrow as pa
import pytest

from quillspark.plans import QUERIES
from tests.test_odd_rows import compare


@pytest.mark.parametrize("name", ["j_related", "j_relink_lexical"])
def test_every_page_asks(spark, tmp_path, name):
    """None of these numbers is a multiple of 20, yet all but the page that shares no token have links."""
    text = ["Alpha beta gamma", "alpha beta delta", "Gamma delta", "epsilon", "zeta alpha", "", "...", "alpha beta gamma"]
    ids = [101, 103, 107, 109, 111, 113, 117, 119]
    source = ["src1", "src2", "src1", "lone", "src2", "src1", "src2", "src1"]
    rows = pa.table({"doc_id": ids, "text": text, "lang": ["en", "de"] * 4, "source": source, "n_chars": [len(t) for t in text]})
    compare(spark, tmp_path, name, "documents", rows)
    assert {r["ord"] for r in QUERIES[name](spark, str(tmp_path)).collect()} >= {101, 103, 107, 111, 119}
