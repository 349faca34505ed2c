from llm_fixtures import DOCS
from test_text_operators import brute_bytes

from wayfold.llm import suffixes


def test_runs_of_nul_are_found(spark):
    nul = "\0"
    texts = [nul * 300, nul * 300, "x" + nul * 40 + "y" * 200, "z" + nul * 40 + "y" * 200, nul * 31 + "w" * 250, nul * 210 + "end", "a" * 150 + nul * 100, None]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    want = brute_bytes(rows)
    assert want[0][1] == want[1][1] == 300
    got = suffixes.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
