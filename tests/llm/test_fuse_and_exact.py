import hashlib
import re

import numpy as np
import pytest

from plethora.llm import exact_dedup, fuse


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 30000])
def test_filter_holds_its_keys(n):
    random = np.random.default_rng(n)
    keys = random.integers(0, 2**63, n).astype(np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    others = random.integers(0, 2**63, 50000).astype(np.uint64)
    assert fuse.contains(blob, others).mean() < 0.008
    assert n < 1000 or len(blob) < 1.5 * n


def test_groups_of_odd_rows(spark, odd):
    got = exact_dedup.exact_groups(odd).collect()
    texts = {}
    for r in odd.collect():
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).digest()
        texts.setdefault(key, []).append(r["doc_id"])
    assert len(got) == sum(map(len, texts.values()))
    for key, ids in texts.items():
        rows = [r for r in got if bytes(r["digest"]) == key]
        known = [i for i in ids if i is not None]
        assert {r["keep_id"] for r in rows} == {min(known) if known else None}
        assert {r["n"] for r in rows} == {len(ids)} and sum(r["kept"] for r in rows) == 1


def test_empty_table(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
