"""Queries over whole passages against brute force on small tables."""
import random
from difflib import SequenceMatcher

import pytest

from provena.operators import evaluate
from provena.plans import queries as own


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passages = [[word() for _ in range(n)] for n in (3, 4, 5, 6, 12, 20)]
    docs = []
    for p in passages:
        n = len(p)
        for wrong in ([], [0], [1], [n - 1], [2, n - 1], [0, n - 1], [0, 1], [2, n - 2, n - 1]):
            w = [x[:3] + "z" + x[4:] if i in wrong else x for i, x in enumerate(p)]
            docs += [[word(), *w, word()], [word(), *w[:-1], word()]]
    d = tmp_path_factory.mktemp("whole")
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", passages)):
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{key} long, text string").write.parquet(str(d / f"{name}.parquet"))
    return str(d), passages, docs


def near(p, w):
    """Whether a run of w is p but for one (from 6 words on two) misspelled words, the first or the second being right."""
    for at in range(len(w) - len(p) + 1):
        miss = [i for i, x in enumerate(p) if x != w[at + i]]
        if 0 < len(miss) <= (1 if len(p) < 6 else 2) and not {0, 1} <= set(miss) and all(SequenceMatcher(None, p[i], w[at + i], autojunk=False).ratio() >= 0.75 for i in miss):
            return True
    return False


def test_near_phrase_takes_whole_passages(spark, small):
    d, passages, docs = small
    asked = [(r.item_id, r.family, r.query.split()) for r in evaluate.typo_mutations(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id").collect()]
    want = {(i, f, j) for i, f, p in asked for j, w in enumerate(docs) if len(p) >= 3 and near(p, w)}
    assert {(r.item_id, r.family, r.doc_id) for r in own.near_phrase(spark, d).collect()} == want and len({x for x in want if x[1] == "exact"}) > 20


def test_align_takes_every_document_that_contains_a_passage(spark, small):
    d, passages, docs = small
    want = {(i, j) for i, p in enumerate(passages) for j, w in enumerate(docs) if near(p, w) or any(w[k : k + len(p)] == p for k in range(len(w)))}
    rows = own.align_claims(spark, d).collect()
    got = {(r.item_id, r.doc_id) for r in rows}
    assert want <= got and max(r.rank or 0 for r in rows) == 8
