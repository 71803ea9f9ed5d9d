"""Operator 10: personal data by generators of candidate spans and gradient-boosted trees.

Base spans come from fixed patterns and always stay. Generators of high recall propose further, also overlapping spans: written-out
or bracketed mail addresses, telephone numbers without a country's sign, in two groups or, beside a word for them, in none, card numbers with other separators,
in groups or of fifteen digits, defanged, long-form and shortened network addresses. Boosted trees (numpy, logistic loss) score each by its format and its surroundings; thresholds
are set per kind on examples kept apart, and of overlapping spans the best scored stays. The trees learn from at most
``EXAMPLES`` base spans and as many candidates of each kind, by hash of their surroundings, so no kind crowds out another: base spans, and the same rewritten in other notations, are examples of
personal data; candidates whose checks fail (check digit, ranges, counts) and base spans spoilt in that way are examples of none;
candidates that pass them are no examples, the trees alone decide about them.

Defined results: a null or empty text has no spans; repeated rows have the same spans; offsets are code points, ends exclusive;
an empty table gives an empty result; without any base span to learn from only base spans (none) are found; further columns pass
through, and if one is called pii, underscores are appended to the new one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacut.llm.common import fresh, read, settle, settled, slices

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, TREES, DEPTH, RATE, PRECISION = 1000, 40, 3, 0.3, 0.98
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # possessive: later starts in a run of digits can't match either
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += (2 * d - 9 if d > 4 else 2 * d) if k % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns that pass their checks, by kind and then start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, end := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(n := x.lstrip("0")) <= 3 and int(n or 0) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdecimal() and c.isascii() for c in m.group()) <= 15]
    return out


GENERATORS = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+ {0,2}(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\]| at |＠) {0,2}[A-Za-z0-9-]++(?: {0,2}(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]| dot |\.) {0,2}[A-Za-z0-9-]++)+", re.IGNORECASE), re.compile(r"[(\[{<]at|[(\[]@| at [^\n]*?(?:dot|\.[a-z])|＠", re.IGNORECASE)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot ) ?[0-9]{1,3}+){3}(?![0-9])", re.IGNORECASE), re.compile(r"[0-9] ?(?:[\[(]\.|[\[(]dot| dot )", re.IGNORECASE)),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,5}(?![0-9A-Za-z:])"), re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?P<s>[ ./_  -]{1,3})[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}(?![0-9])"), re.compile(r"[0-9]{4}[ ./_  -]{1,3}[0-9]{4}[^0-9]")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}[ ./_-][0-9]{6}[ ./_-][0-9]{5}(?![0-9])"), re.compile(r"[0-9]{4}[ ./_-][0-9]{6}[ ./_-]")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"), re.compile(r"[0-9A-Fa-f]::[0-9A-Fa-f]")),
    ("card", re.compile(r"(?<![0-9])3[47][0-9]{13}(?![0-9])"), re.compile(r"3[47][0-9]{13}")),
    ("phone", re.compile(r"(?<![0-9+.(-])\([0-9]{2,5}\)[ ./-]{0,2}[0-9]{3,4}[ ./-]?[0-9]{3,5}(?![0-9]|[.-][0-9])"), re.compile(r"\([0-9]{2,5}\)")),
    ("phone", re.compile(r"(?<![0-9+.(-])0[0-9]{2,4}[ /-][0-9]{5,8}(?![0-9]|[.-][0-9])"), re.compile(r"0[0-9]{2,4}[ /-][0-9]{5}")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.,+$€#/-])[0-9]{9,11}(?![0-9A-Za-z]|[.,-][0-9])"), re.compile(r"(?:tel|phone|fax|mobil|cell|call|dial|whatsapp)[^\n]{0,24}[0-9]{9}", re.IGNORECASE)),
    ("phone", re.compile(r"(?<![0-9+.(-])(?:00 ?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,5}){1,4}(?![0-9]|[.-][0-9])"), re.compile(r"[0-9]\)?[ ./-]{1,2}[0-9]{2,4}[ .-][0-9]{2}")),
)


def candidates(text: str) -> list[Span]:
    out = []
    for kind, pattern, sign in GENERATORS:
        if sign.search(text):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


WORDS = {"phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp"), "card": ("card", "visa", "credit", "debit", "master", "amex", "payment"), "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "addr", "server", "client", "login")}
OTHER = ("version", "ver", "isbn", "date", "order", "id", "page", "section", "no.", "http", "invoice", "$", "€")
AROUND = 32


def row(text: str, span: Span) -> list[float]:
    """Format and context features of a span."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - AROUND) : a], text[b : b + 8]
    digits = re.sub(r"[^0-9]", "", s)
    groups = [len(x) for x in re.findall(r"[0-9]+", s)]
    seps = re.findall(r"[^0-9A-Za-z]+", s)
    numbers = [int(x[:6]) for x in re.findall(r"[0-9]+", s)]
    low = before.lower()
    year = any(1900 <= n <= 2099 and len(str(n)) == 4 for n in numbers)
    first = numbers[0] if numbers else 0
    letters = sum(c.isalpha() for c in s)
    tld = re.search(r"([A-Za-z]{2,12})$", s)
    return [
        *(float(kind == k) for k in KINDS), len(digits), len(s), len(groups), *(groups + [0] * 5)[:5], max(groups, default=0), min(groups, default=0),
        len(seps), len(set(seps)), max(map(len, seps), default=0), float("(" in s), float("+" in s), float(luhn(digits)) if digits else 0.0, float(16 <= len(digits) <= 19),
        max(numbers, default=0) > 255, float(year), float(first <= 31), letters / max(1, len(s)), float(bool(tld)), float(len(tld[1])) if tld else 0.0, s.count(":"),
        float(any(w in low for w in WORDS[kind])), float(any(w in low for w in OTHER)), float(before[-1:].isalnum()), float(before[-1:] in "=/#\"'_"), float(after[:1].isalnum()), float(after[:1] in "=/#\"'_"), sum(c.isdigit() for c in before) / AROUND,
    ]


def sound(text: str, span: Span) -> bool:
    """Whether a candidate passes the checks of its kind."""
    kind, a, b = span
    s = text[a:b]
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "card":
        return 15 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone" and re.fullmatch(r"[0-9]{9,11}", s):  # without any sign of its own, only beside a word that says so
        return any(w in text[max(0, a - AROUND) : a].lower() for w in WORDS["phone"])
    if kind == "phone" and re.fullmatch(r"\([0-9]{2,5}\)[ ./-]{0,2}[0-9]{3,4}[ ./-]?[0-9]{3,5}|0[0-9]{2,4}[ /-][0-9]{5,8}", s):
        return 9 <= len(digits) <= 15
    if kind == "ip" and "::" in s:
        return bool(re.match(r"fe80|fd|fc|ff|2[0-9a-f]{3}", s.lower())) and not re.search(r"[0-9A-Fa-f]{1,4}::.*::", s)
    if kind == "phone":
        groups = [len(x) for x in re.findall(r"[0-9]+", s)]
        return 9 <= len(digits) <= 15 and 3 <= max(groups) <= 5 and len(groups) >= 3 and not re.search(r"\b(?:19|20)[0-9]{2}\b", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in re.findall(r"[0-9]+", s)[:4]) if ":" not in s else s.count(":") >= 4 and not re.fullmatch(r"[0-9]{1,2}(:[0-9]{2})+", s)
    return True


def rewritten(rng: np.random.Generator, text: str, span: Span) -> list[tuple[str, Span, bool]]:
    """A base span in other notations, in its place; and one that is none any more."""
    kind, a, b = span
    s, out = text[a:b], []

    def put(new: str, true: bool) -> None:
        out.append((text[max(0, a - AROUND) : a] + new + text[b : b + 8], (kind, min(a, AROUND), min(a, AROUND) + len(new)), true))

    digits = re.sub(r"[^0-9]", "", s)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == "email":
        local, domain = s.split("@", 1)
        put(local + pick("(at)", " [at] ", " at ", "＠", " (at) ") + domain.replace(".", pick(".", "(dot)", " [dot] ", " dot ")), True)
        put(local.split(".")[0] + " at " + pick("the", "home", "10") + "." + pick("3", "Then", "It"), False)
    elif kind == "ip":
        put(s.replace(".", pick("[.]", "(.)", " dot ", "[dot]")), True)
        put(":".join(f"{int(x):x}" for x in rng.integers(0, 65536, 8)), True)
        put(pick("fe80", "2001:db8", "fd00:1", "2a02") + "::" + ":".join(f"{int(x):x}" for x in rng.integers(1, 65536, int(rng.integers(1, 4)))), True)
        put(pick("a", "b", "dd", "add") + "::" + pick("c", "bad", "fee", "d"), False)
        put(f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}:{rng.integers(0, 60):02d}", False)
        put("[.]".join(str(x) for x in rng.integers(256, 999, 4)), False)
    elif kind == "card":
        put(pick(".", "/", "_", "  ", " ").join(digits[k : k + 4] for k in range(0, 16, 4)) if len(digits) == 16 else s, True)
        amex = "3" + pick("4", "7") + "".join(map(str, rng.integers(0, 10, 12)))
        check = next(d for d in "0123456789" if luhn(amex + d))
        put(amex + check, True)
        put(amex + str((int(check) + int(rng.integers(1, 9))) % 10), False)
        spoilt = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 9))) % 10)
        put(pick(".", "/", "-", " ").join(spoilt[k : k + 4] for k in range(0, 16, 4)), False)
    else:
        put(pick("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "00{} {} {}").format(digits[-10:-7] or "555", digits[-7:-4], digits[-4:]), True)
        area, rest = digits[-10:-7] or "555", digits[-7:]
        put(pick("({}){}-{}", "({}) {}{}").format(area, rest[:3], rest[3:]) if len(digits) >= 9 else f"0{area} {rest}", True)
        put(f"0{area[:3]}{pick(' ', '/', '-')}{rest}", True)
        plain = area + rest if len(area + rest) >= 9 else "030" + rest
        if any(w in text[max(0, a - AROUND) : a].lower() for w in WORDS["phone"]):
            put(plain, True)
        else:
            said, other = pick("phone ", "tel ", "call ", "fax: "), pick("order ", "no. ", "id ", "sum ", "")
            out.append((said + plain, (kind, len(said), len(said) + len(plain)), True))
            out.append((other + plain, (kind, len(other), len(other) + len(plain)), False))
        put(f"{rng.integers(1900, 2099)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", False)
        put(" ".join(str(x) for x in rng.integers(10, 99, 4)), False)
    return out


class Trees:
    """Boosted regression trees for the logistic loss; splits at quantiles, leaves by one Newton step."""

    def __init__(self):
        self.trees: list[list[tuple[int, float, float]]] = []
        self.limits = dict.fromkeys(KINDS, 1.1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 17)[1:-1], method="lower")) for k in range(x.shape[1])]
        z = np.zeros(len(x))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            tree: list[tuple[int, float, float]] = []
            place = np.zeros(len(x), np.int64)  # heap numbering
            for node in range(2 ** (DEPTH + 1) - 1):
                own = place == node
                gs, hs = g[own].sum(), h[own].sum() + 1
                best = (1e-6, -1, 0.0)
                if node < 2**DEPTH - 1 and own.sum() > 5:
                    for k, values in enumerate(cuts):
                        for c in values:
                            right = x[own, k] > c
                            gr, hr = g[own][right].sum(), h[own][right].sum() + 1
                            gain = gr * gr / hr + (gs - gr) ** 2 / (hs - hr + 1) - gs * gs / hs
                            if gain > best[0]:
                                best = (gain, k, float(c))
                tree.append((best[1], best[2], RATE * gs / hs))
                if best[1] >= 0:
                    place[own] = 2 * node + 1 + (x[own, best[1]] > best[2])
            self.trees.append(tree)
            z += self._one(tree, x)

    @staticmethod
    def _one(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, leaf = (np.array(v) for v in zip(*tree, strict=True))
        place = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[place]
            place = np.where(f >= 0, 2 * place + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[place]), place)
        return leaf[place]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum((self._one(t, x) for t in self.trees), np.zeros(len(x)))))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Per kind the least threshold from which on the share of true examples is ``PRECISION``."""
        p = self.score(x)
        for k, kind in enumerate(KINDS):
            own = x[:, k] == 1
            if own.any():
                order = np.argsort(-p[own])
                true, scores = np.cumsum(y[own][order]), p[own][order]
                good = np.flatnonzero(true / np.arange(1, len(true) + 1) >= PRECISION)
                self.limits[kind] = max(0.5, float(scores[good[-1]])) if len(good) else 1.1


def examples(docs: DataFrame, most: int = EXAMPLES) -> list[tuple[str, str, int, int, bool]]:
    """(context, kind, start, end, base): spans of the corpus with their surroundings, of each kind at most ``most`` base ones and as many others, by hash."""
    columns = ("hash", "context", "kind", "a", "b", "base")

    @settled
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[str, bool], set] = {}
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for base, spans in ((True, base_spans(text)), (False, candidates(text))):
                    for kind, a, b in spans:
                        at = max(0, a - AROUND)
                        own = (text[at : b + 8], kind, a - at, b - at, base)
                        cell = cells.setdefault((kind, base), set())
                        cell.add((zlib.crc32(repr(own).encode("utf-8", "replace")), *own))
                        if len(cell) > 4 * most:
                            cells[kind, base] = set(sorted(cell)[:most])
        rows = [x for cell in cells.values() for x in sorted(cell)[:most]]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], list(columns))

    found = docs.where("text is not null").select(F.col("text").cast("string")).mapInArrow(emit, "hash long, context string, kind string, a int, b int, base boolean")
    nth = F.row_number().over(Window.partitionBy("kind", "base").orderBy(*columns))
    # at most 2 * most rows of each kind
    return sorted((tuple(r)[1:-1] for r in found.distinct().withColumn("nth", nth).where(F.col("nth") <= most).collect()), key=lambda x: (x[1], x[4], x))


def train(docs: DataFrame, most: int = EXAMPLES) -> Trees:
    model, rows, marks, apart = Trees(), [], [], []
    seen: Counter = Counter()
    for context, kind, a, b, base in examples(docs, most):
        span = (kind, a, b)
        # a candidate that passes its kind's checks may be either; only one that fails is an example, of none
        made = rewritten(np.random.default_rng(zlib.crc32(context.encode())), context, span) if base else [(context, span, False)] if not sound(context, span) else []
        for text, s, true in made:
            rows.append(row(text, s))
            marks.append(true)
            apart.append(seen[kind, base] % 4 == 3)
        seen[kind, base] += 1
    if len(set(marks)) < 2:
        return model
    x, y, kept = np.array(rows, float), np.array(marks, float), np.array(apart)
    model.fit(x[~kept], y[~kept])
    for k in range(len(KINDS)):  # a kind with too few examples to keep some apart has its threshold from all of them
        if not (kept & (x[:, k] == 1) & (y == 1)).any():
            kept = kept | (x[:, k] == 1)
    model.calibrate(x[kept], y[kept])
    return model


def more_spans(text: str, base: list[Span], model: Trees) -> list[Span]:
    """Candidates over their thresholds, clear of base spans and of better ones."""
    if not model.trees:
        return []
    proposed = [s for s in candidates(text) if not any(s[1] < b and a < s[2] for _, a, b in base)]
    if not proposed:
        return []
    scores = model.score(np.array([row(text, s) for s in proposed], float))
    taken: list[Span] = []
    for p, s in sorted(zip(scores.tolist(), proposed, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2])):
        if p >= model.limits[s[0]] and not any(s[1] < b and a < s[2] for _, a, b in taken):
            taken.append(s)
    return taken


SPANS = "struct<base:array<struct<kind:string,start:int,end:int>>,spans:array<struct<kind:string,start:int,end:int>>>"


def find(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with pii: base spans, and all spans with those that the trees add, by kind and then start."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    order = {k: i for i, k in enumerate(KINDS)}

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        bases, alls = [], []
        for text in (t for at in range(0, len(texts), 1000) for t in texts.slice(at, 1000).to_pylist()):
            base = base_spans(text or "")
            every = sorted(base + more_spans(text or "", base, given.value), key=lambda s: (order[s[0]], s[1]))
            bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            alls.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
        settle()
        return pa.StructArray.from_arrays([pa.array(bases, kind), pa.array(alls, kind)], ["base", "spans"])

    return docs.withColumn(fresh("pii", docs.columns), spans("text"))


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in angle brackets."""
    found = find(docs, model or train(docs))

    @F.arrow_udf("string")
    def replace(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            at, parts = 0, []
            for s in sorted(own or [], key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"<{s['kind']}>"]
                at = max(at, s["end"])
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    pii = found.columns[-1]
    return found.select(*[replace("text", F.col(f"{pii}.spans")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("pii.base").cast("binary"), 256).alias("base_sha256"), listed("pii.spans").alias("spans"))


QUERIES = {"op10_pii": query}
ORACLES: dict[str, str] = {}
