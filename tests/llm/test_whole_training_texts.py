import random

import pyarrow as pa

from plethora.llm import toxicity
from tests.llm.test_classifiers import _texts


def test_insults_late_in_a_text_are_learned(spark):
    r = random.Random(2)
    calm = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda bad: " ".join([*r.choices(calm, k=600), *["worthless idiot"] * 6 * bad, *r.choices(calm, k=20)])
    rows = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(320)]
    assert all(len(t.split("worthless")[0]) > 2000 for _, t, bad in rows if bad)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    clean, toxic = model.score(pa.array([text(0) for _ in range(40)])), model.score(pa.array([text(1) for _ in range(40)]))
    assert (toxic >= toxicity.THRESHOLD).mean() > 0.95 and (clean >= toxicity.THRESHOLD).mean() < 0.1


def test_runs_taken_alone_have_the_n_grams_of_the_text(monkeypatch):
    """A step sees of each run what scoring sees of it in its text."""
    import numpy as np

    from plethora.llm.subword import BagModel, fold

    seen, fit_bags = [], BagModel.fit_bags

    def watched(self, take, labels, *args):
        seen.append(take(np.arange(len(labels))))
        fit_bags(self, take, labels, *args)

    monkeypatch.setattr(BagModel, "fit_bags", watched)
    texts = [*_texts(20, 0, 3), "  odd,  spaces -- and é words\n\nhere ", *_texts(5, 1, 3)]
    toxicity.train(texts, [0] * 21 + [1] * 5)
    want = []
    for t in texts:
        folded = fold(np.frombuffer(t.encode(), np.uint8))
        starts, _ = toxicity.runs(folded, np.zeros(1, np.int64))
        found = np.stack(list(toxicity.buckets(folded, np.zeros(1, np.int64))), 1)
        for a, b in zip(starts, [*starts[1:], len(folded)]):
            want.append(found[a:b][found[a:b] < 1 << toxicity.BITS])
    want = [w for w in want if len(w)]
    assert seen[0][1].tolist() == [len(w) for w in want] and (seen[0][0] == np.concatenate(want)).all()
