import hashlib
import random

from plethora.llm import chunking
from plethora.llm import fingerprints as fp
from plethora.llm.chunking import MAX, MIN, chunk_sets, containment


def test_chunks_survive_an_insertion():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(2000)).encode()
    a, b = chunk_sets([text, text[:5000] + b"inserted words" + text[5000:]])
    assert containment(a, b) > 0.97
    sizes = [int(x) & 255 for x in a]
    assert max(sizes) <= MAX and sum(n < MIN for n in sizes) <= 1  # the last chunk may be short
    assert fp.unpacked(fp.packed_set(a)).tolist() == a.tolist()


def test_what_stands_before_does_not_matter():
    one, _ = chunk_sets([b"the same text as ever, long enough to be cut", b"zz"])
    _, two = chunk_sets([b"something else before it", b"the same text as ever, long enough to be cut"])
    assert one.tolist() == two.tolist()


def test_likeness_bounds():
    none, some = chunk_sets([b"", b"abc def ghi jkl mno"])
    assert containment(none, none) == 1 and containment(none, some) == 0 == containment(some, none) and containment(some, some) == 1


def test_neighbours_against_a_loop(spark, odd, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    got = sorted((r["id"] if r["id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in fp.neighbours(odd).collect())
    want = []
    for k, (i, t) in enumerate(rows):
        other, n = rows[(k + 1) % len(rows)][1], len(t) // 3
        want.append((i if i is not None else -1, len(t), hashlib.sha256((t[: len(t) - n] + other[:n]).encode()).hexdigest()))
    assert got == sorted(want)
    assert fp.neighbours(empty).count() == 0
    same = fp.fingerprint_column(odd.limit(3))
    assert same.columns == [*odd.columns, "fingerprint"]


def plain_chunks(data):
    """The chunks of a text one byte at a time: (digest, length) of each distinct one."""
    whole, found, start = 1 << 64, set(), 0
    gear = lambda p: sum(int(chunking._GEAR[data[p - j]]) << (4 * j) for j in range(8)) % (1 << 32)
    while start < len(data):
        end = len(data)
        for p in range(start + chunking.MIN - 1, len(data)):
            size = p + 1 - start
            if size > chunking.MAX:
                break
            if gear(p) < 1 << (32 - (chunking.STRICT if size <= chunking.NORMAL else chunking.LOOSE)) or size == chunking.MAX:
                end = p + 1
                break
        part = data[start:end]
        h = (sum(int(chunking._VALUE[c]) * int(chunking._PLACE[k]) for k, c in enumerate(part)) + len(part)) % whole
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * factor % whole
        found.add(((h ^ h >> 33) >> 24, len(part)))
        start = end
    return found


def plain_likeness(a, b):
    if not a:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a if (d, n) in b) / sum(n for _, n in a)


def as_set(fingerprint):
    return {(int(x) >> 8, int(x) & 255) for x in fp.unpacked(fingerprint)}


def test_fingerprints_and_likenesses_against_a_plain_loop(spark, odd):
    """Boundaries, digests and both likenesses of whole texts, byte by byte."""
    from tests.conftest import SF

    for docs in (spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000"), odd.where("text IS NULL OR length(text) < 6000").dropDuplicates(["doc_id"])):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
        got = {r["id"]: r for r in fp.neighbours(docs).collect()}
        assert len(got) == len(rows)
        sets = [plain_chunks(t.encode()) for _, t in rows]
        for k, (i, t) in enumerate(rows):
            after = (k + 1) % len(rows)
            cut = len(t) // 3
            edited = plain_chunks((t[: len(t) - cut] + rows[after][1][:cut]).encode())
            r = got[i]
            assert as_set(r["fingerprint"]) == sets[k] and as_set(r["edited_fingerprint"]) == edited
            assert abs(r["near_edited"] - plain_likeness(sets[k], edited)) < 1e-12 and abs(r["near_next"] - plain_likeness(sets[k], sets[after])) < 1e-12


def test_edited_is_nearer_than_next(spark):
    from tests.conftest import SF

    rows = [r for r in fp.query(spark, SF).collect() if r["n_chars"] >= 200]
    assert sum(r["near_edited"] > 0.5 for r in rows) > 0.97 * len(rows) and sum(r["near_next"] < 0.3 for r in rows) > 0.97 * len(rows)
