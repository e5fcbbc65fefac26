import random
import re

import pyarrow as pa

from listloom.llm import decontaminate
from listloom.llm import kernels as K


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, items):
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    out = {}
    for i, t in docs:
        w = split(t)
        for j, x in items:
            x = split(x)
            n = len(x)
            best = min(((distance(w[k : k + n], x), k) for k in range(len(w) - n + 1)), default=(n + 1, 0)) if n else (1, 0)
            if n and best[0] <= int(0.2 * n):
                out[i, j] = (best[1], n, best[0])
    return out


def test_edited_passages(spark, documents, sf_dir, write_tables, odd):
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:12]
    rows = []
    for k in range(60):
        j, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.randrange(int(0.15 * len(w)) + 1)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
        around = documents.text[k].split()[:60]
        rows.append((k, " ".join(around[:30] + w + around[30:]), None, None, 0))
    want = brute([r[:2] for r in rows], items)
    folder = write_tables(spark.createDataFrame(rows, odd.schema), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.op8_decontaminate(spark, folder).collect()}
    assert len(found.keys() & want.keys()) >= 0.98 * len(want) > 40 and not found.keys() - want.keys()
    assert sum(found[k] == want[k] for k in found) >= 0.98 * len(found)


def found_in(docs, block):
    data, at = K.utf8(pa.array([t for _, t in docs], pa.string()))
    return {(docs[i][0], j): rest for i, j, *rest in map(list, block.find(data, at))}


def test_recall_at_the_edit_limit(spark, sf_dir):
    rng = random.Random(5)
    items = [(r["item_id"], " ".join(r["text"].split())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    block = decontaminate.Block(items)
    direct = decontaminate.Block(items, recall=1.1)  # no number of repetitions is enough: windows are compared one by one
    assert set(direct.repeats.values()) == {0}
    for indels in (False, True):
        docs = []
        for i in range(400):
            w = items[i % len(items)][1].split()
            most = int(0.2 * len(w))
            if indels:
                for _ in range(most // 2):
                    del w[rng.randrange(len(w))]
                    w.insert(rng.randrange(len(w) + 1), f"w{rng.randrange(10**6)}")
            else:
                for at in rng.sample(range(len(w)), most):
                    w[at] = f"w{rng.randrange(10**6)}"
            side = [f"z{rng.randrange(10**6)}" for _ in range(10)]
            docs.append((i, " ".join(side[:5] + w + side[5:])))
        want = {}
        for i, t in docs:
            want |= brute([(i, t)], [items[i % len(items)]])
        found = found_in(docs, block)
        assert len(want) > 350 and sum(k in found for k in want) >= 0.98 * len(want)
        whole = found_in(docs, direct)
        assert {k: tuple(whole.get(k, ())) for k in want} == want


def test_passages_cut_by_the_ends_of_a_text(spark, sf_dir):
    items = [(r["item_id"], " ".join(r["text"].split())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    block, docs, want = decontaminate.Block(items), [], {}
    for j, text in items:
        w, side = text.split(), [f"z{j}x{k}" for k in range(60)]
        n, most = len(w), int(0.2 * len(w))
        for kind, (words, spot) in enumerate((
            (w[: n // 2] + w[n // 2 + 1 :], (0, n - 1, 1)),
            (side + w[:-most], (60, n - most, most)),
            (w[most:] + side, (0, n - most, most)),
            (w[: -most - 1], None),
        )):
            docs.append((10 * j + kind, " ".join(words)))
            if spot:
                want[10 * j + kind, j] = spot
    assert {k: tuple(v) for k, v in found_in(docs, block).items()} == want


def test_exact_passages_and_clean_documents(spark, sf_dir, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    inside = {(i, j) for i, t in zip(documents.doc_id.tolist(), documents.text, strict=True) for j, x in items if x in t}
    found = decontaminate.op8_decontaminate(spark, sf_dir).collect()
    assert inside and inside == {(r["doc_id"], r["item_id"]) for r in found if r["edits"] == 0}


def test_cost_follows_the_hits_not_the_benchmark(monkeypatch):
    """Zipf words: all common words and pairs are some item's, yet few windows are keyed or checked."""
    rng = random.Random(4)
    common = [f"w{k}" for k in range(2000)]
    weight = [1 / (k + 1) for k in range(2000)]
    text = lambda n: " ".join(rng.choices(common, weight, k=n))
    docs = [(k, text(300)) for k in range(60)]
    looked = []
    judge = decontaminate.Block._judge
    monkeypatch.setattr(decontaminate.Block, "_judge", lambda self, n, own, *rest: looked.append(len(own)) or judge(self, n, own, *rest))
    for n in (100, 3000):
        looked.clear()
        found_in(docs, decontaminate.Block([(k, text(rng.randint(24, 60))) for k in range(n)]))
        assert sum(looked) <= 2.0 * 60 * 300


def test_long_items_are_found_by_keys():
    rng = random.Random(9)
    items = [(j, " ".join(f"w{rng.randrange(5000)}" for _ in range(300))) for j in range(12)]
    block, docs = decontaminate.Block(items), []
    assert block.repeats[300] > 0
    for j, text in items:
        w = text.split()
        for at in rng.sample(range(300), 60 if j % 2 else 10):
            w[at] = f"z{rng.randrange(10**6)}"
        docs.append((j, " ".join(["a b c d"] + w + ["e f g"])))
    found = found_in(docs, block)
    assert found.keys() == {(j, j) for j in range(12)} and all(v == [4, 300, 60 if j % 2 else 10] for (j, _), v in found.items())


def test_an_item_of_some_thousand_words_takes_bounded_memory():
    import tracemalloc

    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(5000)]
    block = decontaminate.Block([(1, " ".join(words)), (2, "x y z")], edits=0.02)
    tracemalloc.start()
    found = found_in([(0, " ".join(words[:100] + ["new"] + words[100:])), (1, " ".join(words[2500:]))], block)
    assert found == {(0, 1): [0, 4999, 2]} or found == {(0, 1): [0, 5000, 2]}, found
    assert tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()


def test_odd_rows(spark, odd, write_tables, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "one two three four five"), (5, "One, two; three four five!"), (None, "x")], "item_id long, text string")
    rows = decontaminate.op8_decontaminate(spark, write_tables(odd, benchmark=items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} >= {(9, 3), (4, 4), (4, 5), (5, 4)}
    assert decontaminate.op8_decontaminate(spark, write_tables(empty)).collect() == []
    assert decontaminate.op8_decontaminate(spark, write_tables(odd, benchmark=items.limit(0))).collect() == []
