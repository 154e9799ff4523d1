"""Operator 3: toxicity by classifier chains with out-of-fold links."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import bounded_batches, load, materialize, tidied

MAX_ROWS = 12_000  # labelled rows that the chain is fitted on
FEATURES = 800  # kept for each category, see choose_features
MIN_DOCS = 4  # labelled documents that a feature must occur in
MOST = 0.05  # rate of a feature in a document beyond which it counts no more in choosing features
FOLDS = 4
WINDOW = 7  # characters of the longest beginning of a token that is a feature
CHUNK, CHUNK_CHARS, TOKENS = 100, 1 << 19, 20_000  # texts and characters that are read together; distinct tokens that are looked up together
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]{2,}")


def features_of(token: str) -> set[str]:
    """A token within marks of its start and end, its beginnings of 3 to 7 characters, and its 5-grams."""
    t = f"^{token}$"
    return {t, *(t[:n] for n in range(3, 8)), *(t[i: i + 5] for i in range(len(t) - 4))}


def numbered(texts: list) -> tuple[list[np.ndarray], list[str]]:
    """Each text's tokens, in order, as numbers, and the tokens that they stand for: runs of letters and digits, and runs of two or more other marks."""
    number = _numbers()
    ids = [np.array(list(map(number.__getitem__, _TOKEN.findall((x or "").lower()))), np.int64) for x in texts]
    return ids, list(number)


def _numbers() -> defaultdict:
    """Numbers what it is asked for, from 0. It must not refer to itself: it would stay, with all tokens, until the collector comes."""
    return defaultdict(itertools.count().__next__)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents, the first by a hash of their id: (id, text, one 0/1 column a category).

    categories: name -> SQL expression over the label table. Labels of a repeated id count as set if any is; rows with
    a null id or category are left out. Of a repeated document id one row of text is taken, the smallest.
    """
    y = (labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.expr(e).cast("int").alias(f"y_{c}") for c, e in categories.items()])
         .groupBy("id").agg(*[F.max(f"y_{c}").alias(f"y_{c}") for c in categories]).dropna())
    have = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    chosen = y.join(have, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.join(F.broadcast(chosen), "id")  # max_rows rows of a few integers
                       .groupBy("id", *[f"y_{c}" for c in categories]).agg(F.min("text").alias("text")))


def choose_features(sample: DataFrame, categories: list[str], k: int, min_docs: int = MIN_DOCS) -> list[str]:
    """For each category the k features whose mean rate differs most between documents with it and without.

    A feature's rate in a document is its occurrences over the document's tokens, at most MOST. The difference of the mean rates is
    divided by the root of the rate over all documents; ties go by name. Features of fewer than min_docs documents are left out.
    """
    cats = len(categories)

    def run(batches):
        number, seen = _numbers(), np.zeros((cats + 2, 1))
        for b in batches:
            ys = [b.column(i + 1).to_numpy() != 0 for i in range(cats)]
            for s in range(0, b.num_rows, CHUNK):
                texts = b.column(0).slice(s, CHUNK).to_pylist()
                e = s + len(texts)
                ids, names = numbered(texts)
                of = [list(map(number.__getitem__, features_of(t))) for t in names]
                size, flat = np.array([len(x) for x in of], np.int64), np.array(list(itertools.chain.from_iterable(of)), np.int64)
                text, at = _spread(ids, np.cumsum(size) - size, size)
                d = max(len(number), 1)
                got, n = np.unique(text * d + flat[at], return_counts=True)
                text, f = got // d, got % d
                rate = np.minimum(n / np.array([len(x) for x in ids], np.int64)[text], MOST)
                if d > seen.shape[1]:
                    seen = np.pad(seen, ((0, 0), (0, d + d // 4 - seen.shape[1])))
                for k, weight in enumerate([None, rate, *(rate * y[s:e][text] for y in ys)]):
                    seen[k, :d] += np.bincount(f, weight, d)
        names = list(number)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(x[: len(names)], pa.float64()) for x in seen]], ["f", "n", "r", *[f"r_{c}" for c in categories]])

    sums = ["n", "r", *[f"r_{c}" for c in categories]]
    counts = (sample.select("text", *[f"y_{c}" for c in categories]).mapInArrow(tidied(run), "f string, " + ", ".join(f"{c} double" for c in sums))
              .groupBy("f").agg(F.sum("n").alias("n"), *[F.round(F.sum(c), 9).alias(c) for c in sums[1:]]).where(F.col("n") >= min_docs))
    counts = materialize(counts)
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y_{c}").alias(c) for c in categories]).first()
    out: set[str] = set()
    for c in categories:
        n, pos = total["n"], total[c] or 0
        if not n or pos in (0, n):
            continue
        apart = F.abs(F.col(f"r_{c}") / pos - (F.col("r") - F.col(f"r_{c}")) / (n - pos)) / F.sqrt(F.col("r") / n + 1e-6)
        out |= {r[0] for r in counts.orderBy(F.desc(F.round(apart, 9)), "f").limit(k).select("f").collect()}  # k rows
    return sorted(out)


def _spread(ids: list[np.ndarray], first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, position) of all that the texts' tokens stand for: token k for the positions first[k] to first[k] + count[k]."""
    flat, every = np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([len(x) for x in ids], np.int64)
    n = count[flat]
    text = np.repeat(np.repeat(np.arange(len(ids)), every), n)
    return text, np.repeat(first[flat] - np.cumsum(n) + n, n) + np.arange(len(text))


def fit_logistic(x: np.ndarray, y: np.ndarray, use: np.ndarray | None = None, l2: float = 2e-5, rounds: int = 400) -> np.ndarray:
    """Weights (bias last) of a linear model with logistic loss over the rows in `use` (0/1); accelerated gradient descent, deterministic.

    The rows left out only get no weight, so that no copy of x is made.
    """
    n, d = x.shape
    use = np.ones(n, np.float32) if use is None else use.astype(np.float32)
    total = float(use.sum())
    w, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    step = 1.0 / (0.25 * _norm(x) * n / total + l2)
    t = 1.0
    for _ in range(rounds):
        z = x @ v[:-1] + v[-1]
        g = (1.0 / (1.0 + np.exp(-z)) - y) * use
        grad = np.append(x.T @ g / total + l2 * v[:-1], g.sum() / total).astype(np.float32)
        new = v - step * grad
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / u * (new - w), new, u
    return w


def _norm(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x/n with the bias column, by power iteration, slightly raised."""
    n, d = x.shape
    q = np.ones(d + 1, np.float32)
    top = 1.0
    for _ in range(15):
        z = x @ q[:-1] + q[-1]
        r = np.append(x.T @ z, z.sum()) / n
        top = float(np.linalg.norm(r)) or 1.0
        q = (r / top).astype(np.float32)
    return top * 1.1


def _p(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(x @ w[:-1] + w[-1])))


def fit_chain(x: np.ndarray, ys: list[np.ndarray], folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector a category. Model i sees x and the probabilities of categories before it; in fitting these
    come from models of the other folds, so that a later model doesn't trust what was learned by heart.

    x: the features, and behind them a column for every category but the last, which is filled here.
    """
    fold = np.arange(len(x)) % folds
    d, out = x.shape[1] - len(ys) + 1, []
    for i, y in enumerate(ys):
        xi = x[:, : d + i]
        out.append(fit_logistic(xi, y))
        if i + 1 < len(ys):
            p = np.zeros(len(x), np.float32)
            for f in range(folds):
                a, b = fold != f, fold == f
                if b.any():
                    p[b] = _p(xi[b], fit_logistic(xi, y, a)) if a.any() else 0.5
            x[:, d + i] = p
    return out


class Chain:
    """A fitted chain: the features' places and the weights; a few hundred kB whatever the corpus.

    Texts are taken a chunk at a time: each distinct token of a chunk is looked up once, all together. Whole tokens are looked up
    as strings, their beginnings and 5-grams by a hash of the characters, and what the hash finds is compared character by character.
    """

    def __init__(self, names, features, weights):
        self.names, self.weights = names, weights
        self.index = {f: i for i, f in enumerate(features)}
        self.short = np.array([i for f, i in self.index.items() if len(f) <= WINDOW], np.int64)
        self.codes = np.zeros((len(self.short), WINDOW), np.uint64)
        for row, f in zip(self.codes, [f for f in self.index if len(f) <= WINDOW]):
            row[: len(f)] = _codes(f)
        for seed in itertools.count():
            self.steps = np.random.default_rng([81, seed]).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
            keys = self.codes @ self.steps
            if len(np.unique(keys)) == len(keys):  # no two features share a hash
                break
        order = np.argsort(keys)
        self.short, self.codes, self.keys = self.short[order], self.codes[order], keys[order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[keys >> np.uint64(48)] = True

    def _found(self, codes: np.ndarray, at: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows of n characters from `at`, with hashes h: which are features, and their places."""
        maybe = np.flatnonzero(self.filter[h >> np.uint64(48)])
        row = np.searchsorted(self.keys, h[maybe])
        same = row < len(self.keys)
        maybe, row = maybe[same], row[same]
        same = self.keys[row] == h[maybe]
        maybe, row = maybe[same], row[same]
        window = codes[at[maybe][:, None] + np.arange(WINDOW)]
        window[:, n:] = 0
        same = (window == self.codes[row]).all(1)
        return maybe[same], self.short[row[same]]

    def places(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token's number, place) of every feature of every token (see features_of), in order of both."""
        marked, get = [f"^{t}$" for t in tokens], self.index.get
        whole = np.array([get(t, -1) for t in marked], np.int64)
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        start = np.cumsum(size) - size
        codes = np.append(_codes("".join(marked)), np.zeros(WINDOW, np.uint64))
        owners, places = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]]
        h = codes[start] * self.steps[0] + codes[start + 1] * self.steps[1] if len(start) else np.zeros(0, np.uint64)
        for n in range(3, WINDOW + 1):  # beginnings; one that is the whole token is counted above
            h = h + codes[start + n - 1] * self.steps[n - 1]
            longer = np.flatnonzero(size > n)
            which, place = self._found(codes, start[longer], h[longer], n)
            owners.append(longer[which])
            places.append(place)
        h = sum((codes[k: len(codes) - WINDOW + k] * self.steps[k] for k in range(5)), np.zeros(len(codes) - WINDOW, np.uint64))
        at, place = self._found(codes, np.arange(len(h)), h, 5)
        owner = np.searchsorted(start, at, "right") - 1
        inside = at + 5 <= (start + size)[owner]
        owners.append(owner[inside])
        places.append(place[inside])
        d = max(len(self.index), 1)
        both = np.sort(np.concatenate(owners) * d + np.concatenate(places))
        both = both[np.diff(both, prepend=-1) > 0]
        return both // d, both % d

    def rows(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, place, value) of the features of all texts, in order: five times the root of their rates."""
        ids, names = numbered(texts)
        found = [self.places(names[k: k + TOKENS]) for k in range(0, len(names), TOKENS)]
        owner = np.concatenate([np.zeros(0, np.int64), *(o + k * TOKENS for k, (o, _) in enumerate(found))])
        place = np.concatenate([np.zeros(0, np.int64), *(p for _, p in found)])
        first, d = np.searchsorted(owner, np.arange(len(names) + 1)), max(len(self.index), 1)
        text, at = _spread(ids, first[:-1], np.diff(first))
        got = np.bincount(text * d + place[at], minlength=1)
        some = np.flatnonzero(got)
        text = some // d
        return text, some % d, 5 * (got[some] / np.array([len(x) for x in ids])[text]) ** 0.5

    def predict(self, texts: list) -> np.ndarray:
        """A row of probabilities, in the categories' order, for every text."""
        out = np.zeros((len(texts), len(self.weights)))
        for s, e in _chunks(texts):
            owner, place, value = self.rows(texts[s:e])
            for i, w in enumerate(self.weights):
                w = w.astype(np.float64)
                z = np.bincount(owner, w[place] * value, minlength=e - s) + w[-1] + out[s:e, :i] @ w[len(self.index): len(self.index) + i]
                out[s:e, i] = 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))
        return out


def _codes(text: str) -> np.ndarray:
    """The characters as numbers, from 1."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _chunks(texts: list):
    """(first, end) of runs of at most CHUNK texts and, but for a longer text alone, CHUNK_CHARS characters."""
    s = held = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > s and (k - s >= CHUNK or held + n > CHUNK_CHARS):
            yield s, k
            s, held = k, 0
        held += n
    if s < len(texts):
        yield s, len(texts)


CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_ROWS, features: int = FEATURES) -> Chain:
    """Fit the chain, in the categories' order, on a sample of at most max_rows labelled documents (see labelled_sample)."""
    categories = categories or CATEGORIES
    names = list(categories)
    sample = labelled_sample(docs, labels, categories, id_col, text_col, max_rows)
    feats = choose_features(sample, names, features)
    chain = Chain(names, feats, [])

    def run(batches):
        for b in batches:
            at, value = [], []
            for s in range(0, b.num_rows, CHUNK):
                texts = b.column(1).slice(s, CHUNK).to_pylist()
                owner, place, v = chain.rows(texts)
                cuts = np.searchsorted(owner, np.arange(1, len(texts)))
                at += np.split(place.astype(np.int32), cuts)
                value += np.split(v.astype(np.float32), cuts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), *[b.column(i) for i in range(2, b.num_columns)]],
                                             ["id", "at", "value", *[f"y_{c}" for c in names]])

    got = (sample.select(F.col("id").cast("long").alias("id"), "text", *[f"y_{c}" for c in names])
           .mapInArrow(tidied(run), "id long, at array<int>, value array<float>, " + ", ".join(f"y_{c} int" for c in names)).orderBy("id").toArrow())  # max_rows rows
    x = np.zeros((got.num_rows, len(feats) + len(names) - 1), np.float32)
    at, value = got["at"].combine_chunks(), got["value"].combine_chunks()
    x[pc.list_parent_indices(at).to_numpy(), pc.list_flatten(at).to_numpy()] = pc.list_flatten(value).to_numpy()
    ys = [got[f"y_{c}"].to_numpy().astype(np.float32) for c in names]
    weights = fit_chain(x, ys) if got.num_rows else [np.zeros(len(feats) + i + 1, np.float32) for i in range(len(names))]
    if not got.num_rows:
        for w in weights:
            w[-1] = -60  # nothing known: nothing is predicted
    chain.weights = weights
    return chain


def score(docs: DataFrame, chain: Chain, text_col: str = "text", keep: list[str] | None = None, prefix: str = "p_") -> DataFrame:
    """The `keep` columns and <prefix><category> for every document, over its whole text."""
    bounded_batches(docs.sparkSession)
    keep = keep or docs.columns
    names = [f"{prefix}{c}" for c in chain.names]

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            p = np.concatenate([np.zeros((0, len(names))), *(chain.predict(texts.slice(s, CHUNK).to_pylist()) for s in range(0, b.num_rows, CHUNK))])
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(names))]], [*keep, *names])

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(tidied(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` double" for n in names)]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
             keep: list[str] | None = None, **kw) -> DataFrame:
    """Per document: the `keep` columns (default the id), p_<category> of the chain, toxic and kept.

    A null or empty text gets the probabilities of no feature at all. Repeated rows are scored each; extra columns are
    ignored unless kept; an empty table gives an empty result, and without usable labels nothing is toxic. Very long
    texts are read whole: a feature counts by its rate among the text's tokens. No shuffle of the documents. The chain is
    fitted on at most max_rows labelled documents and on `features` features a category that at least MIN_DOCS of these
    have; everything else is not a feature of it.
    """
    chain = train(docs, labels, id_col=id_col, text_col=text_col, **kw)
    out = score(docs, chain, text_col, keep or [id_col])
    return out.withColumn("toxic", F.col("p_toxic") >= threshold).withColumn("kept", ~F.col("toxic"))


def op3_toxicity(spark, sf_dir):
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL = None  # tested by held-out accuracy and against a brute-force version
