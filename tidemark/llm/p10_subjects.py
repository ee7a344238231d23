"""Problem 10: the subjects of each document, from labelling functions and a latent-class model.

Labelling functions vote on sentences: each word and word pair of a lexicon (what a sentence says and
the frame it says it in), the source of the document, its section (doc_type) and its address (the
participant).  What a sentence is about, one subject or none, is the latent class; how reliably each
function's vote goes with each class is learned by expectation-maximisation on a sample of documents
that annotators have labelled.  A label only says that the document has sentences of that subject,
and may be wrong, so it enters as a prior of its sentences.  A word of a subject in another sense
stands in frames that also occur where no subject is present, and these frames outvote it.

A document is about the subjects whose sentences, by posterior, are at least SHARE of its sentences,
if it has MIN_SENTENCES.  Null, empty and short texts are about none.  All documents are scored, one
pass, no shuffle; the sample is at most TRAIN_PER_LANG documents a language and TRAIN_MAX in all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.confusables import skeleton
from tidemark.llm.textsim import slices
from tidemark.plans.staging import spread, stage

SHARE, MIN_SENTENCES = 0.3, 3
TRAIN_PER_LANG, TRAIN_MAX = 2_500, 6_000
ROUNDS, SMOOTH, LEAST_COUNT = 6, 0.05, 3
LEAN = 1.0
#: Prior of a sentence in a labelled document: share of its labels, of each other subject.
LABELLED, OTHER = 0.5, 0.003
#: Reference tables are lists kept by hand.
REF_LIMIT = 50_000

MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
HEADING = re.compile(r"^[ \t]*#{1,6}[ \t].*$", re.MULTILINE)
LEAD = re.compile(r"[ \t]*(?:[-*•][ \t]+(?:-[ \t]+)*|\d+[.)][ \t]+|\[[\d:.]+\][ \t]*(?:[^\W\d_]+[ \t]?:)?|D\d+[ \t]+\d+:\d+[ \t]*\|)", re.IGNORECASE)
#: A full stop behind one of these ends no sentence; the gap behind it is kept from the breaks by a private character.
TITLE, KEPT = re.compile(r"\b(Dr|Mr|Ms|St|Nr|Sr|Mrs|Prof)\.[ \t]+"), "\ue000"
BREAK = re.compile(r"(?<=[.!?])[\"”»')\]]*\s+|(?<=[。！？])[”」』]*\s*|(?<=[㐀-鿿][.!?])\s*(?=[㐀-鿿])|\x1e")
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
CJK = re.compile(r"([㐀-鿿])")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, without markup, headings and what leads a line of a list or an export."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r", "\n")
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    text = skeleton_lines(text)
    if "#" in text:
        text = HEADING.sub("\x1e", text)
    text = "\n".join(["\x1e" + line[m.end() :] if (m := LEAD.match(line)) else line for line in text.split("\n")])
    if titles := TITLE.search(text):
        text = TITLE.sub(rf"\1.{KEPT}", text)
    found = [s for s in map(str.strip, BREAK.split(text)) if LETTER.search(s)]
    return [s.replace(KEPT, " ") for s in found] if titles else found


def skeleton_lines(text: str) -> str:
    """The consistent form of each line (see confusables), lines kept, letters composed again."""
    if text.isascii():
        return text
    import unicodedata

    return "\n".join(unicodedata.normalize("NFC", skeleton(line)) for line in text.split("\n"))


def tokens(sentence: str) -> list[str]:
    """Lower-case words and numbers; each CJK character a word."""
    return WORD.findall(sentence.lower() if sentence.isascii() else CJK.sub(r" \1 ", sentence).lower())


def words(sentence: str, names: frozenset[str]) -> list[str]:
    """tokens() with names of the roster and numbers as such."""
    return ["<n>" if w in names else "<9>" if w[0].isdigit() else w for w in tokens(sentence)]


class Numbers(dict):
    """Token to word id: names of the roster count as <n>, numbers as <9>, what is not known as 0."""

    def __init__(self, vocabulary: dict[str, int], names: Iterable[str]):
        super().__init__(vocabulary)
        self.update(dict.fromkeys(names, vocabulary.get("<n>", 0)))
        self.digits = vocabulary.get("<9>", 0)

    def __missing__(self, token: str) -> int:
        return self.digits if token[0].isdigit() else 0


@dataclass
class Model:
    """Votes (log likelihood by class) of the labelling functions; class 0 is no subject."""

    subjects: list[str]
    names: frozenset[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    single: np.ndarray = field(default_factory=lambda: np.empty(0))
    pair_codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0))
    context: dict[str, np.ndarray] = field(default_factory=dict)
    prior: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: (kind, key, vote, n_votes, accuracy) of each labelling function.
    functions: list[tuple[str, str, str, int, float]] = field(default_factory=list)

    def narrow(self) -> Model:
        """The same model with votes of single precision, for scoring."""
        return replace(self, single=self.single.astype(np.float32), pairs=self.pairs.astype(np.float32), functions=[])

    def numbers(self) -> Numbers:
        return Numbers(self.vocabulary, self.names)

    def features(self, lists: list[list[str]], get: Numbers | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word ids, their sentence, pair indexes, their sentence) of lists of tokens; get is numbers(), made once for many calls."""
        get = get or self.numbers()
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(map(get.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(lists)), sizes)
        joined = (of[1:] == of[:-1]) if len(of) else np.empty(0, bool)
        code = (ids[:-1] << 24 | ids[1:])[joined] if len(ids) else ids
        where = of[:-1][joined] if len(of) else of
        if not len(self.pair_codes):
            return ids, of, np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.clip(np.searchsorted(self.pair_codes, code), 0, len(self.pair_codes) - 1)
        known = self.pair_codes[at] == code
        return ids, of, at[known], where[known]

    def posterior(self, lists: list[list[str]], context: list[list[str]], prior: np.ndarray | None = None, get: Numbers | None = None) -> np.ndarray:
        """Class probabilities of each sentence; context: the source, section and address of its document."""
        ids, of, at, where = self.features(lists, get)
        k = len(self.subjects) + 1
        score = np.tile(self.prior, (len(lists), 1)) if prior is None else np.log(prior)
        for index, values, rows in ((ids, self.single, of), (at, self.pairs, where)):
            if len(index):
                begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                score[rows[begin]] += np.add.reduceat(values[index], begin, axis=0)
        if self.context:
            zero = np.zeros(k)
            keys = [tuple(c) for c in context]
            table = {c: sum((self.context.get(x, zero) for x in c), zero) for c in set(keys)}
            score += np.array([table[c] for c in keys])
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def _context(source: str | None, section: str | None, address: str | None) -> list[str]:
    return [f"source:{source}", f"section:{section}", f"address:{address}"]


def _log_table(weight: np.ndarray, rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """log P(feature | class) by weighted counts; features shifted so that an absent vote is no vote."""
    k = weight.shape[1]
    counts = np.empty((n, k))
    for c in range(k):
        counts[:, c] = np.bincount(index, weight[rows, c], n)
    total = counts.sum(axis=0)
    log = np.log((counts + SMOOTH) / (total + SMOOTH * n))
    # Against the mean of the classes; what leans less than LEAN says nothing: frames are shared by
    # all subjects, and their small leans would add up over the many words of a frame.
    lean = log - log[:, 1:].mean(axis=1, keepdims=True)
    lean[:, 1:] = np.sign(lean[:, 1:]) * np.maximum(np.abs(lean[:, 1:]) - LEAN, 0)
    return lean


def train(documents: Iterable[tuple], subjects: list[str], names: Iterable[str], rounds: int = ROUNDS) -> Model:
    """Learn the votes from labelled documents: (text, source, section, address, labels)."""
    model = Model(sorted(subjects), frozenset(n.lower() for n in names))
    k = len(model.subjects) + 1
    number = {s: i + 1 for i, s in enumerate(model.subjects)}
    lists, context, prior = [], [], []
    for text, source, section, address, labels in documents:
        own = sorted(number[x] for x in labels if x in number)
        if not own and "none" not in labels:
            continue
        p = np.full(k, OTHER)
        if own:
            p[own] = LABELLED / len(own)
        p[0] = 0.0
        p[0] = 1 - p.sum()
        for s in sentences(text):
            lists.append(tokens(s))
            context.append(_context(source, section, address))
            prior.append(p)
    model.prior = np.zeros(k)
    if not lists:
        return model
    plain = lambda w: "<n>" if w in model.names else "<9>" if w[0].isdigit() else w
    seen = Counter(map(plain, chain.from_iterable(lists)))
    model.vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_COUNT))}
    n_words = len(model.vocabulary) + 1
    ids, of, _, _ = model.features(lists)
    joined = of[1:] == of[:-1]
    code = (ids[:-1] << 24 | ids[1:])[joined]
    values, n = np.unique(code, return_counts=True)
    model.pair_codes = values[n >= LEAST_COUNT]
    ids, of, at, where = model.features(lists)
    places = sorted({x for c in context for x in c})
    place_of = {x: i for i, x in enumerate(places)}
    rows = np.repeat(np.arange(len(lists)), 3)
    place = np.array([place_of[x] for c in context for x in c])
    prior = np.array(prior)
    p = prior
    for _ in range(rounds):
        model.single = _log_table(p, of, ids, n_words)
        model.pairs = _log_table(p, where, at, len(model.pair_codes)) if len(model.pair_codes) else np.empty((0, k))
        votes = _log_table(p, rows, place, len(places))
        model.context = {x: votes[i] for x, i in place_of.items()}
        p = model.posterior(lists, context, prior)
    model.prior = np.log((p.sum(axis=0) + 1) / (len(p) + k))
    known = {i: w for w, i in model.vocabulary.items()}
    pair = lambda c: f"{known.get(int(c) >> 24, '?')} {known.get(int(c) & 0xFFFFFF, '?')}"
    spoken = [known.get(i, "?") for i in range(n_words)]
    for kind, votes, rows_, index, keys in (("word", model.single, of, ids, spoken), ("pair", model.pairs, where, at, [pair(c) for c in model.pair_codes]), ("", votes, rows, place, places)):
        model.functions += _functions(kind, votes, p, rows_, index, keys, model.subjects)
    return model


def _functions(kind: str, votes: np.ndarray, p: np.ndarray, rows: np.ndarray, index: np.ndarray, keys: list[str], subjects: list[str]) -> list[tuple[str, str, str, int, float]]:
    """Each labelling function with the class it votes for and the accuracy learned for it: how probable that class is where it votes.

    The vote of a word or a pair is the class it leans to most; one that leans to none does not vote.
    """
    if not len(votes):
        return []
    vote = votes.argmax(axis=1)
    n = np.bincount(index, minlength=len(votes))
    right = np.bincount(index, p[rows, vote[index]], len(votes))
    out = []
    for i in np.flatnonzero((n > 0) & (votes.max(axis=1) > votes.min(axis=1))):
        what, key = (kind, keys[i]) if kind else keys[i].split(":", 1)
        out.append((what, key, subjects[vote[i] - 1] if vote[i] else "none", int(n[i]), float(right[i] / n[i])))
    return out


def sample(documents: DataFrame, labels: DataFrame) -> list[tuple]:
    """The training sample: labelled documents in the order of a hash, bounded by language and in all."""
    votes = labels.select("doc_id", F.lower(F.trim("subject")).alias("label")).where("label is not null and label <> ''").groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    order = F.xxhash64("doc_id")
    # Only ids and languages are ranked; no partition sends more than the bound, and texts are fetched for the chosen ids alone.
    ranked = (
        documents.where("text is not null")
        .select("doc_id", "lang")
        .join(votes, "doc_id", "left_semi")
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")))
        .where(F.col("n") <= TRAIN_PER_LANG)
    )
    chosen = stage(ranked.orderBy(order, "doc_id").limit(TRAIN_MAX).select("doc_id"), "p10-sample")
    texts = documents.where("text is not null").select("doc_id", "text", "source", "doc_type", "participant_source_id").join(F.broadcast(chosen), "doc_id")
    own = votes.join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = texts.join(F.broadcast(own), "doc_id").orderBy(order, "doc_id").select("text", "source", "doc_type", "participant_source_id", "labels").collect()
    return [tuple(r) for r in rows]


def _listed(df: DataFrame) -> list:
    """The rows of a reference table, which is kept by hand; ValueError beyond REF_LIMIT."""
    rows = df.limit(REF_LIMIT + 1).collect()
    if len(rows) > REF_LIMIT:
        raise ValueError(f"a reference table of more than {REF_LIMIT} rows")
    return rows


def fitted(documents: DataFrame, labels: DataFrame, reference: DataFrame, roster: DataFrame) -> tuple[Model, dict[str, str]]:
    """(model, subject in lower case to subject as it is written)."""
    shown = {r[0].strip().lower(): r[0] for r in sorted(_listed(reference.select("subject").where("subject is not null").distinct()))}
    names = [n for r in _listed(roster.select("display_name", "aliases")) for n in [r[0], *(r[1] or [])] if n]
    return train(sample(documents, labels), list(shown), names), shown


def functions(documents: DataFrame, labels: DataFrame, reference: DataFrame, roster: DataFrame) -> DataFrame:
    """kind, key, vote, n_votes, accuracy: the labelling functions with the accuracy learned for each.

    As many rows as the sample has words, pairs, sources, sections and addresses that vote.
    """
    model, shown = fitted(documents, labels, reference, roster)
    rows = [(kind, key, shown.get(vote, vote), n, accuracy) for kind, key, vote, n, accuracy in model.functions]
    return documents.sparkSession.createDataFrame(rows, "kind string, key string, vote string, n_votes bigint, accuracy double")


def shares(documents: DataFrame, labels: DataFrame, reference: DataFrame, roster: DataFrame) -> DataFrame:
    """doc_id, n_sentences, subject, share: the expected share of sentences about each subject, where above 0.05."""
    model, shown = fitted(documents, labels, reference, roster)
    shared = documents.sparkSession.sparkContext.broadcast((model.narrow(), shown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shown = shared.value
        get = model.numbers()
        for batch in batches:
            for i, j in slices(batch.column(1), 1000):
                part = batch.slice(i, j - i)
                ids, texts, *where = (c.to_pylist() for c in part.columns)
                lists, context, begins, kept = [], [], [], []
                for d, (text, *place) in enumerate(zip(texts, *where)):
                    found = sentences(text)
                    if len(found) >= MIN_SENTENCES:
                        begins.append(len(lists))
                        kept.append((ids[d], len(found)))
                        lists.extend(map(tokens, found))
                        context.extend([_context(*place)] * len(found))
                if not kept or not len(model.single):
                    continue
                p = np.add.reduceat(model.posterior(lists, context, get=get), np.array(begins), axis=0)
                n = np.array([x for _, x in kept])
                share = p / n[:, None]
                d, s = np.nonzero(share[:, 1:] > 0.05)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kept[x][0] for x in d], pa.int64()), pa.array(n[d], pa.int32()), pa.array([shown[model.subjects[x]] for x in s], pa.string()), pa.array(share[d, s + 1], pa.float64())],
                    names=["doc_id", "n_sentences", "subject", "share"],
                )

    columns = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "doc_type", "participant_source_id").where("text is not null")
    return spread(columns).mapInArrow(run, "doc_id bigint, n_sentences int, subject string, share double")


def found(documents: DataFrame, labels: DataFrame, reference: DataFrame, roster: DataFrame) -> DataFrame:
    """doc_id, subject: the subjects that at least three in ten sentences are about."""
    # Half a per mille: posteriors are not quite one.
    return shares(documents, labels, reference, roster).where(F.col("share") >= SHARE - 0.005).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, labels: DataFrame, reference: DataFrame, roster: DataFrame) -> DataFrame:
    """subject, n_documents, n_chars: the corpus by subject; a document of several counts for each."""
    hits = found(documents, labels, reference, roster)
    sizes = documents.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return hits.join(sizes, "doc_id").groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum("n_chars").alias("n_chars"))
