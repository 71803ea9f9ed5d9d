import numpy as np

from stratacut.llm import filter_audit as fa


def plain(rows, labels):
    """Every order run over every row."""
    mark = {}
    for doc_id, good, toxic in labels:
        if doc_id is None:
            continue
        old = mark.get(doc_id, (0, 0))
        mark[doc_id] = (max(old[0], good == 1), max(old[1], toxic == 1))
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = []
        for doc_id, text, lang in rows:
            if (lang or "") != part:
                continue
            t = text or ""
            words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
            bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                   "D": any(c in "#$%&*|" for c in t), "E": doc_id is not None and doc_id > smallest[t]}
            own.append((bad, *mark.get(doc_id, (0, 0))))
        whole = dict.fromkeys("ABCDE", 0)
        for order in fa.ORDERS:
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if x[0][f]], [x for x in left if not x[0][f]]
                whole[f] += len(gone)
                failing = [x for x in own if x[0][f]]
                out[part, order, step] = [len(left), len(gone), sum(any(x[0][g] for g in order[: step - 1]) for x in failing), sum(sum(x[0].values()) == 1 for x in failing), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(whole[order[step - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in fa.COUNTS] for r in df.collect()}


def test_audit_equals_every_order_run(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(fa.query(spark, sf)) == plain(rows, labels)


def test_odd_rows(spark):
    long, shout = " ".join(f"word{i}" for i in range(120)), "A#" * 300_000
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (4, None, ""), (5, "", "fr"), (5, "", "fr"), (None, long, "en"), (None, "", None), (6, shout, "en"), (7, "É" * 50, "fr"), (7, long, "fr")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (None, 1, 1), (5, 1, 1)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string")
    marks = spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, quality int, toxic int, good int")
    assert found(fa.audit(docs, marks)) == plain(rows, labels)
    assert fa.audit(docs.limit(0), marks).count() == 0
    assert fa.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_white_space_and_bounds():
    assert fa.own_failures(" ".join(["a b"] * 50).encode()) == 0b10  # 100 words, 2 distinct
    assert fa.own_failures("\x0b\x1c".join(f"w{i}" for i in range(100)).encode()) == 0
    words = [f"w{i}" for i in range(80)] + ["w0"] * 20
    assert fa.own_failures(" ".join(words).encode()) == 0
    assert fa.own_failures(" ".join(words[1:] + ["w5"]).encode()) == 0 and fa.own_failures(" ".join(words[:79] + ["w0"] * 21).encode()) == 2
    assert fa.own_failures(b"AB" + b"c" * 18) & 4 == 0 and fa.own_failures(b"ABC" + b"c" * 18) & 4


def test_steps_are_the_smallest_positions():
    fails = np.array([[0, 0, 0, 0, 0], [1, 0, 0, 1, 0]], bool)
    steps = fa.removal_steps(fails, ["ABCDE", "EDCBA"])
    assert steps.tolist() == [[5, 5], [0, 1]]
