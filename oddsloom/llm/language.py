"""Language of each word, and of each document, by a linear-chain conditional random field.

A word's label scores are sums of learned weights: its prefixes and suffixes of one to three letters, its letter
pairs and triples, its first letters' case, and, if it is in the lexicon, the whole word. Learned transitions
tie neighbouring words together, so that a foreign phrase in a text stands out as a run. Forward-backward gives
each word's label probabilities; a document's score for a language is the mean over its words, and the largest
is the prediction. Words are runs of letters, so every word has a letter.

Labels only compare learned languages with each other. Whether a text is in any of them is judged beside the field: letters
given the two before them, by language, against a background that knows single letters only. A text is accepted if its words,
each under the languages that the field gives it, weighed by their probabilities, are together about as likely as under the
background (`LEAST_GAIN`); texts that switch languages are accepted. Without a model only texts without a letter are not.

Fitting uses a bounded sample of the labelled rows: at most about `sample_docs` documents of each language with
at most `sample_chars` characters, chosen by hash, whole. Everything else reads all rows and whole texts: a batch
is worked on as arrays of letters, and long chains are cut into blocks whose transfer matrices are composed, so
neither long texts nor many short ones cost Python steps per word.

Nulls: a null text, or one without a letter, is `und` with score 0; a null label is not learned from. Ties go to
the first language in order. Repeated rows are predicted alike. Other columns are ignored. No rows: no rows; no
labelled rows: everything is `und`. Beyond `most_labels` labels only those with most rows are learned, ties by name; texts
in others are predicted as the nearest learned one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from oddsloom.llm.words import mix64, once_per_worker, text_slices
from oddsloom.session import settle

SAMPLE_DOCS = 200
SAMPLE_CHARS = 20_000
EPOCHS = 20
#: Rows of the hashed weight table.
TABLE_BITS = 18
#: A word of the sample is in the lexicon from this count on.
LEXICON_COUNT = 5
UNKNOWN = "und"
#: Labels that are learned.
MOST_LABELS = 256
#: Nats a letter by which a text must be likelier in learned languages than by the background.
LEAST_GAIN = -0.5
#: Weight of the shorter context in a letter's probability, share of unseen letters in the background, and in a language.
BACK_OFF, UNSEEN, UNSEEN_IN_LANGUAGE = 4.0, 0.25, 1e-6
#: Words of a block of a chain.
BLOCK = 64
SLICE_BYTES = 1 << 19

_GUESS = StructType().add("id", "long").add("lang_pred", "string").add("score", "double")


def _letter_table() -> np.ndarray:
    """For every code point: 0 if no letter, 1 lower case or uncased, 2 upper case."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            kinds[c] = 2 if ch.isupper() else 1
    return kinds


def _both_tables() -> tuple[np.ndarray, np.ndarray]:
    """Letter kinds, and the lower case of each code point that has a single one."""
    kinds, lower = _letter_table(), np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(kinds == 2):
        low = chr(c).lower()
        lower[c] = ord(low) if len(low) == 1 else c
    return kinds, lower


def _tables() -> tuple[np.ndarray, np.ndarray]:
    return once_per_worker("letters", _both_tables)


@dataclass
class Letters:
    """The words of some texts: lower-case letters in a row, where words start in it, words before each text,
    the code point at which each word starts, and the code points before each text."""

    code: np.ndarray
    start: np.ndarray
    length: np.ndarray
    before: np.ndarray
    upper: np.ndarray
    at: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Letters:
        kinds, lower = _tables()
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # Code points before a byte position: bytes that start one.
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        cuts = heads[offsets]
        kind = kinds[points]
        inside = kind > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = cuts[:-1][cuts[:-1] < len(points)]
        begins[firsts] = inside[firsts]
        at = np.flatnonzero(begins)
        place = np.cumsum(inside) - inside
        start = place[at]
        code = lower[points[inside]].astype(np.uint64)
        length = np.diff(np.append(start, len(code)))
        return cls(code, start, length, np.searchsorted(at, cuts), kind[at] == 2, at, cuts)

    def hashes(self, letters: int | None = None) -> np.ndarray:
        """Of each whole word, or of its first `letters` letters."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        nth = np.arange(len(self.code)) - np.repeat(self.start, self.length)
        value = mix64(self.code) * np.power(np.uint64(0x9E3779B97F4A7C15), nth.astype(np.uint64))
        length = self.length
        if letters:
            value[nth >= letters] = 0
            length = np.minimum(length, letters)
        return mix64(np.add.reduceat(value, self.start) + length.astype(np.uint64))


def _slot(value: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(value * np.uint64(64) + np.uint64(kind)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


class Features:
    """Weight-table rows of the words: one per word and affix, one per letter and n-gram."""

    def __init__(self, words: Letters, lexicon: np.ndarray | None):
        self.words, n = words, len(words.code)
        pad = np.concatenate([words.code, np.zeros(3, np.uint64)])
        two = pad[:n] << np.uint64(21) | pad[1 : n + 1]
        three = two << np.uint64(21) | pad[2 : n + 2]
        owner = np.repeat(np.arange(len(words.start)), words.length)
        left = words.start[owner] + words.length[owner] - np.arange(n)
        # Letter n-grams within a word; those that would cross its end go to a row of their own that stays zero.
        self.grams = [np.where(left >= k, _slot(v, k), -1) for k, v in ((1, pad[:n]), (2, two), (3, three))]
        end = words.start + words.length
        self.affixes = []
        for k, v in ((1, pad[:n]), (2, two), (3, three)):
            fits = words.length >= k
            self.affixes.append(np.where(fits, _slot(v[words.start], 8 + k), -1))
            self.affixes.append(np.where(fits, _slot(v[np.maximum(end - k, 0)], 16 + k), -1))
        self.affixes.append(_slot(words.upper.astype(np.uint64), 30))
        self.hash = words.hashes()
        if lexicon is not None:
            at = np.searchsorted(lexicon, self.hash)
            known = np.zeros(len(at), bool)
            if len(lexicon):
                known = lexicon[np.minimum(at, len(lexicon) - 1)] == self.hash
            self.affixes.append(np.where(known, _slot(self.hash, 31), -1))

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Label scores of each word; the table's last row is zero. Letter n-grams count by their mean."""
        if not len(self.words.start):
            return np.zeros((0, table.shape[1]), table.dtype)
        out = sum(table[rows] for rows in self.affixes)
        letters = sum(table[rows] for rows in self.grams)
        return out + np.add.reduceat(letters, self.words.start) / self.words.length[:, None].astype(table.dtype)

    def gradient(self, by_word: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size + 1, by_word.shape[1]))
        spread = np.repeat(by_word / self.words.length[:, None], self.words.length, axis=0)
        for k in range(by_word.shape[1]):
            for rows in self.affixes:
                out[:, k] += np.bincount(rows % (size + 1), by_word[:, k], size + 1)
            for rows in self.grams:
                out[:, k] += np.bincount(rows % (size + 1), spread[:, k], size + 1)
        out[-1] = 0
        return out


def forward_backward(scores: np.ndarray, transitions: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of each word, summed pair probabilities, and the log-likelihood norm of each chain.

    `before` has the words before each chain. Chains are cut into blocks of `BLOCK` words; the blocks' transfer
    matrices are composed first, then every block runs on its own from what reaches it."""
    n, labels = scores.shape
    chains = len(before) - 1
    counts = np.diff(before)
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels)), np.zeros(chains)
    per = -(-counts // BLOCK)
    first_block = np.cumsum(per) - per
    blocks = int(per.sum())
    chain = np.repeat(np.arange(chains), per)
    nth = np.arange(blocks) - first_block[chain]
    start = before[:-1][chain] + nth * BLOCK
    size = np.minimum(before[1:][chain] - start, BLOCK)
    top = scores.max(axis=1)
    emit = np.exp(scores - top[:, None])
    step = np.exp(transitions - transitions.max())
    fill = np.ones((blocks, BLOCK, labels))
    inside = np.arange(BLOCK) < size[:, None]
    fill[inside] = emit
    # Transfer matrix of a block: row a is what a state `a` before the block makes of it (the first block has none before).
    moves = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    scale = np.zeros(blocks)
    for i in range(BLOCK):
        on = np.flatnonzero(size > i)
        if not len(on):
            break
        here = moves[on]
        begin = (nth[on] == 0) & (i == 0)
        here = np.where(begin[:, None, None], here, here @ step) * fill[on, i][:, None, :]
        norm = here.sum(axis=(1, 2))
        moves[on] = here / norm[:, None, None]
        scale[on] += np.log(norm)
    # What enters a block from the left, and what follows it on the right, one block of every chain at a time.
    enter, follow, total = np.ones((blocks, labels)), np.ones((blocks, labels)), np.zeros(chains)
    state = np.ones((chains, labels))
    for i in range(int(per.max())):
        on = np.flatnonzero(per > i)
        b = first_block[on] + i
        enter[b] = state[on]
        now = np.einsum("ca,cab->cb", state[on], moves[b])
        norm = now.sum(axis=1)
        state[on] = now / norm[:, None]
        total[on] += np.log(norm) + scale[b]
    state = np.ones((chains, labels))
    for i in range(int(per.max())):
        on = np.flatnonzero(per > i)
        b = first_block[on] + per[on] - 1 - i
        follow[b] = state[on]
        now = np.einsum("cab,cb->ca", moves[b], state[on])
        state[on] = now / now.sum(axis=1)[:, None]
    # Within blocks, all side by side.
    ahead, behind = np.zeros((blocks, BLOCK, labels)), np.zeros((blocks, BLOCK, labels))
    state = enter
    for i in range(BLOCK):
        moved = state @ step
        if i == 0:
            moved = np.where((nth == 0)[:, None], np.ones(labels), moved)
        state = np.where((size > i)[:, None], moved * fill[:, i], state)
        state = state / state.sum(axis=1, keepdims=True)
        ahead[:, i] = state
    state = follow
    for i in range(BLOCK - 1, -1, -1):
        on = size > i
        behind[on, i] = state[on]
        state = np.where(on[:, None], (state * fill[:, i]) @ step.T, state)
        state = state / state.sum(axis=1, keepdims=True)
    both = (ahead * behind)[inside]
    both /= both.sum(axis=1, keepdims=True)
    a, b = ahead[inside], behind[inside] * emit
    linked = np.ones(n, bool)
    linked[before[:-1][counts > 0]] = False
    at = np.flatnonzero(linked)
    left, right = a[at - 1], b[at]
    mass = np.einsum("ia,ab,ib->i", left, step, right)
    pairs = np.einsum("ia,ib->ab", left / mass[:, None], right) * step
    # Every chain starts from ones, as if all first labels were alike.
    gone = np.add.reduceat(np.append(top, 0), np.minimum(before[:-1], n)) * (counts > 0)
    total += gone + np.maximum(counts - 1, 0) * transitions.max()
    return both, pairs, total


@dataclass
class LetterModel:
    """Letters, pairs and triples inside the words of each language, counted in rows of a hashed table."""

    counts: np.ndarray
    totals: np.ndarray
    letters: np.ndarray

    @classmethod
    def of(cls, features: Features, gold: np.ndarray, labels: int) -> LetterModel:
        counts = np.zeros(((1 << TABLE_BITS) + 1, labels), "f4")
        owner = np.repeat(gold, features.words.length)
        for rows in features.grams:
            np.add.at(counts, (rows, owner), 1)
        counts[-1] = 0
        seen, n = np.unique(features.grams[0], return_counts=True)
        letters = np.zeros(len(counts), "f8")
        letters[seen] = (1 - UNSEEN) * n / max(n.sum(), 1)
        totals = np.maximum(np.bincount(owner, minlength=labels), 1).astype("f8")
        return cls(counts, totals, np.where(letters > 0, letters + UNSEEN / (len(seen) + 1), UNSEEN / (len(seen) + 1)))

    def gains(self, features: Features, likely: np.ndarray | None = None) -> np.ndarray:
        """For each word, how much likelier its languages, weighed by their probabilities `likely`, make it than the
        background, in nats; without these, its likeliest language."""
        if not len(features.words.start):
            return np.zeros(0)
        one, two, three = (self.counts[rows].astype("f8") for rows in features.grams)
        after = lambda x: np.concatenate([x[1:], x[:1]])
        letter = (1 - UNSEEN_IN_LANGUAGE) * one / self.totals + UNSEEN_IN_LANGUAGE
        pair = (two + BACK_OFF * after(letter)) / (one + BACK_OFF)
        triple = (three + BACK_OFF * after(pair)) / (two + BACK_OFF)
        words = features.words
        out = np.zeros((len(words.start), one.shape[1]))
        # A word's first letter, its second after the first, and each further one after two.
        inner = np.where((features.grams[2] >= 0)[:, None], np.log(triple), 0)
        out += np.add.reduceat(inner, words.start)
        out += np.log(letter[words.start]) + np.where((words.length > 1)[:, None], np.log(pair[words.start]), 0)
        if likely is not None:
            out += np.log(np.maximum(likely, np.finfo("f8").tiny))
        best = out.max(axis=1) if likely is None else np.logaddexp.reduce(out, axis=1)
        return best - np.add.reduceat(np.log(self.letters[features.grams[0]]), words.start)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    spelling: LetterModel

    def _likely(self, features: Features) -> np.ndarray:
        return forward_backward(features.scores(self.table).astype("f8"), self.transitions, features.words.before)[0]

    def probabilities(self, words: Letters) -> np.ndarray:
        """Of each label for each word."""
        return self._likely(Features(words, self.lexicon))

    def gains(self, words: Letters) -> np.ndarray:
        """For each word, how much likelier the languages that the field gives it make it than the background, in nats."""
        features = Features(words, self.lexicon)
        return self.spelling.gains(features, self._likely(features))


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = 0.5, penalty: float = 1e-6) -> Model:
    """Maximum likelihood by adaptive gradient steps; every word of a training text carries its text's label."""
    labels = sorted(set(langs))
    raw = [t.encode() for t in texts]
    words = Letters.of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
    seen, counts = np.unique(Features(words, None).hash, return_counts=True)
    lexicon = seen[counts >= LEXICON_COUNT]
    features, size = Features(words, lexicon), 1 << TABLE_BITS
    per = np.diff(words.before)
    gold = np.repeat(np.searchsorted(labels, langs), per)
    truth = np.eye(len(labels))[gold]
    same = np.ones(len(gold), bool)
    same[words.before[:-1][per > 0]] = False
    at = np.flatnonzero(same)
    gold_pairs = np.zeros((len(labels), len(labels)))
    np.add.at(gold_pairs, (gold[at - 1], gold[at]), 1)
    table, transitions = np.zeros((size + 1, len(labels)), "f4"), np.zeros((len(labels), len(labels)))
    seen_t, seen_m = np.full(table.shape, 1e-8), np.full(transitions.shape, 1e-8)
    n = max(len(gold), 1)
    for _ in range(epochs):
        likely, pairs, _ = forward_backward(features.scores(table).astype("f8"), transitions, words.before)
        step_t = features.gradient((truth - likely) / n, size) - penalty * table
        step_m = (gold_pairs - pairs) / n - penalty * transitions
        seen_t += step_t**2
        seen_m += step_m**2
        table += (rate * step_t / np.sqrt(seen_t)).astype("f4")
        transitions += rate * step_m / np.sqrt(seen_m)
    return Model(labels, table, transitions, lexicon, LetterModel.of(features, gold, len(labels)))


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, usable: Column, sample_docs: int, sample_chars: int, most_labels: int) -> tuple[list[str], list[str]]:
    """About `sample_docs` labelled texts of each language, by hash, of `most_labels` languages; the fit's only bounded input."""
    fit_rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= sample_chars))
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    rows = fit_rows.select(F.col(lang_col).alias("lang"), part.alias("part"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = settle(counts.orderBy(F.desc("n"), "lang").limit(most_labels).select("lang", (sample_docs / F.col("n")).alias("share")))
    found = rows.join(F.broadcast(share), "lang").filter("part < share").select("text", "lang").collect()
    found.sort()
    return [r.text for r in found], [r.lang for r in found]


def _predict(model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value) if model.value else None
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                n = len(offsets) - 1
                words = Letters.of(data, offsets)
                some = np.flatnonzero(np.diff(words.before) > 0) if m else np.zeros(0, int)
                names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
                if len(some):
                    likely = m.probabilities(words)
                    sums = np.add.reduceat(likely, words.before[some]) / np.diff(words.before)[some, None]
                    names[some] = np.array(m.labels, object)[sums.argmax(axis=1)]
                    scores[some] = np.clip(sums.max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, n), pa.array(names, pa.string()), pa.array(scores)], schema=schema)

    return run


def _accept(model, text_col: str, least: float):
    """The rows whose words fit the languages the field gives them, one or several, decided on Arrow batches of all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value) if model.value else None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for row, data, offsets in text_slices(batch.column(text_col), SLICE_BYTES):
                words = Letters.of(data, offsets)
                some = np.flatnonzero(np.diff(words.before) > 0)
                if m and len(some):
                    letters = np.add.reduceat(words.length, words.before[some])
                    keep[row + some] = np.add.reduceat(m.gains(words), words.before[some]) / letters >= least
                else:
                    keep[row + some] = True
            yield batch.filter(pa.array(keep))

    return run


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, most_labels: int = MOST_LABELS) -> Model | None:
    texts, langs = training_sample(
        docs, id_col=id_col, text_col=text_col, lang_col=lang_col, usable=~held_out(F.col(id_col)), sample_docs=sample_docs, sample_chars=sample_chars, most_labels=most_labels,
    )
    return fit(texts, langs) if texts else None


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of `docs`. The model's size is fixed by its parameters."""
    shared = _share(docs, model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_predict(shared, to_arrow_schema(_GUESS)), _GUESS)
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def _share(docs: DataFrame, model: Model | None):
    parts = model and (model.labels, model.table, model.transitions, model.lexicon, model.spelling)
    return docs.sparkSession.sparkContext.broadcast(parts)


def accepted(docs: DataFrame, model: Model | None, *, text_col: str = "text", least: float = LEAST_GAIN) -> DataFrame:
    """The rows of `docs` whose letters are on average `least` likelier in the languages that the field gives their words than by
    the background, with all their columns; in one narrow pass. Texts without a letter go, without a model only these."""
    return docs.mapInArrow(_accept(_share(docs, model), text_col, least), docs.schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on a bounded sample of the labelled rows that are not held out, then predict every row."""
    return predict(docs, train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col=id_col, text_col=text_col)
