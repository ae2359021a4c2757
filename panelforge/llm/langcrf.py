"""Language of text by a linear-chain conditional random field over words.

Every word gets scores for each language from its features (the word itself, affixes, character n-grams, shape, and
membership in the languages' lexicons; learned weights, all but those of the lexicons in hashed slots), and neighbours are tied by learned transitions. Forward-backward gives each word's
probabilities, also in text that switches language. A text's language is the one with the largest mean probability over
its words with letters; that mean is the score.

Training: words are labelled with the language of their document, in sequences put together from pieces of several
documents so that languages switch. The languages are those of all training rows. The field is fitted on a sample of at
most ``SAMPLE`` of them, each language with the same share as far as it has rows, chosen by hash of the id; of a text of
more than ``LONGEST`` characters a piece of that length takes part, at a place that the hash gives. In each of ``ROUNDS``
rounds at most ``PIECES_A_ROUND`` pieces of it are drawn. A word is in a language's lexicon if at least two documents of
the sample have it and nine in ten of those, weighted so that languages count alike, are of that language; in training,
each half of the documents sees the lexicons of the other half. Every text is predicted whole.

Null texts and texts without letters are ``und`` with score zero. Without any labelled document everything is ``und``.
Rows are independent of each other.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.llm.common import slices
from panelforge.llm.words import WordTable

SAMPLE = 2_500
LONGEST = 20_000
SLOTS = 1 << 16
UNKNOWN = "und"
ROUNDS = 4
PIECES_A_ROUND = 20_000
#: Of a word's documents, the weighted share in one language from which on it is in that language's lexicon.
LEXICAL = 0.9
#: Words of one piece and pieces of one training sequence.
PIECE = 24
PIECES = 3
SLICE = 1 << 20
#: Characters of words whose features are found together.
PART = 1 << 15

_EDGES = ".,;:!?\"'()[]{}|*%$#&-"


def has_letter(word: str) -> bool:
    """Whether any character is a letter to Unicode; digits set high or low and number signs are none."""
    return any(map(str.isalpha, word))


def core_of(word: str) -> str:
    return word.strip(_EDGES).lower() or word


def _byte_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


_STEPS = _byte_steps()


def _fed(state: np.ndarray, char: np.ndarray) -> np.ndarray:
    """States of ``crc32`` after one more character each, in UTF-8."""

    def fed(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return _STEPS[(state ^ byte) & 0xFF] ^ (state >> 8)

    out = fed(state, char)
    wide = np.flatnonzero(char > 0x7F)
    if len(wide):
        c, s = char[wide], np.broadcast_to(state, char.shape)[wide]
        size = 2 + (c > 0x7FF) + (c > 0xFFFF)
        s = fed(s, np.array([0xC0, 0xE0, 0xF0], dtype=np.uint32)[size - 2] | c >> (6 * (size - 1)).astype(np.uint32))
        for left in (2, 1, 0):
            s = np.where(size > left + 1, fed(s, 0x80 | (c >> np.uint32(6 * left)) & 0x3F), s)
        out[wide] = s
    return out


def _begun(kind: bytes) -> np.ndarray:
    """The state of ``crc32`` after the first bytes of names."""
    return np.array([crc32(kind) ^ 0xFFFFFFFF], dtype=np.uint32)


def slots_of(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the features of words given by their cores, word by word, and how many each word has: the word, its shape,
    beginnings and ends of one to four characters, pairs and triples of characters with the marks of both ends."""
    length = np.fromiter(map(len, cores), np.int64, len(cores))
    chars = np.frombuffer("".join([f"^{core}$" for core in cores]).encode("utf-32-le"), dtype="<u4").astype(np.uint32)
    head = np.cumsum(length + 2) - length - 2  # place of each word's first mark
    short = np.minimum(length, 4)
    sizes = 2 + 2 * short + 2 * length + 1
    begins = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint32)
    out[begins] = np.fromiter([crc32(b"w" + core.encode()) for core in cores], np.uint32, len(cores)) ^ np.uint32(0xFFFFFFFF)
    shapes = np.array([crc32(f"s{alpha}{long}".encode()) for alpha in (False, True) for long in (False, True)], dtype=np.uint32) ^ np.uint32(0xFFFFFFFF)
    alpha = np.fromiter([core[:1].isalpha() for core in cores], bool, len(cores))
    out[begins + 1] = shapes[2 * alpha + (length > 3)]
    state = np.repeat(_begun(b"p"), len(cores))
    for n in range(1, 5):
        held = np.flatnonzero(length >= n)
        state[held] = out[begins[held] + 1 + n] = _fed(state[held], chars[head[held] + n])
        ending = _begun(b"e")
        for i in range(n):
            ending = _fed(ending, chars[head[held] + length[held] + 1 - n + i])
        out[begins[held] + 1 + short[held] + n] = ending
    # Pairs begin at every character but a word's last mark, triples at every one but the last two places.
    word = np.repeat(np.arange(len(cores)), length + 2)
    inner = np.arange(len(chars)) - head[word]
    at = np.flatnonzero(inner <= length[word])
    pair = _fed(_fed(_begun(b""), chars[at]), chars[at + 1])
    where = (begins + 2 + 2 * short)[word[at]] + inner[at]
    out[where] = pair
    three = inner[at] < length[word[at]]
    at = at[three]
    out[where[three] + length[word[at]] + 1] = _fed(pair[three], chars[at + 2])
    return ((out ^ np.uint32(0xFFFFFFFF)) % SLOTS).astype(np.int64), sizes


def with_lexicon(cores: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """``slots_of`` with the slot of the lexicon that has the word behind the others."""
    flat, sizes = slots_of(cores)
    label = np.fromiter([lexicon.get(core, -1) for core in cores], np.int64, len(cores))
    held = np.flatnonzero(label >= 0)
    flat = np.insert(flat, np.cumsum(sizes)[held], SLOTS + label[held])
    sizes[held] += 1
    return flat, sizes


def in_parts(cores: list[str]) -> Iterator[list[str]]:
    """The cores in parts of at most ``PART`` characters; a longer one makes a part of its own."""
    part = np.cumsum([len(core) + 2 for core in cores]) // PART
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(cores)]
    for begin, end in zip(cuts, cuts[1:]):
        yield cores[begin:end]


def lexicons(documents: list[set[str]], labels: list[int], k: int) -> dict[str, int]:
    """The language of words that at least two documents have, nearly all of them of that language."""
    number: dict[str, int] = {}
    ids, owners = array("i"), array("i")
    for words, label in zip(documents, labels):
        for word in words:
            ids.append(number.setdefault(word, len(number)))
            owners.append(label)
    if not number:
        return {}
    counts = np.zeros((len(number), k))
    np.add.at(counts, (np.array(ids), np.array(owners)), 1)
    shares = counts / np.maximum(np.bincount(np.array(labels, dtype=np.int64), minlength=k), 1)
    best = shares.argmax(axis=1)
    held = (counts.sum(axis=1) >= 2) & (shares.max(axis=1) >= LEXICAL * shares.sum(axis=1))
    return {word: int(best[i]) for word, i in number.items() if held[i]}


class Tagger:
    """Labels, slot weights and transitions of a trained field."""

    def __init__(self, labels: list[str], lexicon: dict[str, int] | None = None):
        self.labels = labels
        #: Number of the language in whose lexicon a word is. Its slot follows the hashed ones.
        self.lexicon = lexicon or {}
        self.weights = np.zeros((SLOTS + len(labels), len(labels)), dtype=np.float32)
        self.moves = np.zeros((len(labels), len(labels)), dtype=np.float64)
        self.start = np.zeros(len(labels), dtype=np.float64)

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row per word: its score for each label, and whether it has letters."""
        out = np.empty((len(words), len(self.labels) + 1), dtype=np.float32)
        at = 0
        for cores in in_parts(list(map(core_of, words))):
            slots, sizes = with_lexicon(cores, self.lexicon)
            out[at : at + len(cores), :-1] = np.add.reduceat(self.weights[slots], np.cumsum(sizes) - sizes)
            at += len(cores)
        out[:, -1] = [has_letter(w) for w in words]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Label probabilities of every word of sequences laid end to end.

    All sequences step together, the longest first, so that the active ones are always the first ones. With ``pairs``
    also the expected number of moves from each label to each other one, over all sequences.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than each step
    peak = scores.max(axis=1, keepdims=True)
    weight = np.exp((scores - peak).astype(np.float64))
    jump = np.exp(moves)
    alpha = np.empty_like(weight)
    scale = np.empty(len(weight))
    now = np.exp(start) * weight[first]
    for t in range(steps):
        at = first[: active[t]] + t
        if t:
            now = (now[: active[t]] @ jump) * weight[at]
        total = now.sum(axis=1)
        now /= total[:, None]
        alpha[at] = now
        scale[at] = total
    beta = np.ones((0, weight.shape[1]))
    moved = np.zeros_like(jump)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        if len(beta) < n:
            beta = np.concatenate([beta, np.ones((n - len(beta), weight.shape[1]))])
        at = first[:n] + t
        alpha[at] *= beta
        if t:
            later = (weight[at] / scale[at, None]) * beta
            if pairs:
                # The word before still holds its forward part alone; each pair's terms add up to one.
                before = alpha[at - 1]
                total = ((before @ jump) * later).sum(axis=1)
                moved += (before.T @ (later / total[:, None])) * jump
            beta = later @ jump.T
    chance = alpha / alpha.sum(axis=1, keepdims=True)
    return (chance, moved) if pairs else chance


#: Words of a block of ``marginals``.
BLOCK = 64


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The probabilities of ``forward_backward`` in steps that do not grow with the longest sequence.

    Sequences are cut into blocks. A block passes vectors on by one matrix, the product of its words' steps; all blocks
    build theirs together. Then vectors run from block to block, and inside all blocks together, forward and backward.
    """
    k = scores.shape[1]
    n_blocks = -(-lengths // BLOCK)
    head = np.cumsum(n_blocks) - n_blocks  # first block of each sequence
    inner = np.arange(n_blocks.sum()) - np.repeat(head, n_blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, n_blocks) + inner * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, n_blocks) - inner * BLOCK)
    order = np.argsort(-size, kind="stable")  # the longest first, so that the active ones are always the first ones
    begin, size = begin[order], size[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    active = np.searchsorted(-size, -np.arange(BLOCK), side="left")
    weight = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
    jump = np.exp(moves)
    # From the vector before a block's first weight to the one after its last.
    through = np.zeros((len(size), k, k))
    through[:, np.arange(k), np.arange(k)] = weight[begin]
    for t in range(1, int(size[0])):
        n = active[t]
        grown = (through[:n].reshape(-1, k) @ jump).reshape(n, k, k) * weight[begin[:n] + t][:, None, :]
        through[:n] = grown / grown.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((len(size), k)), np.ones((len(size), k))
    into[place[head]] = np.exp(start)
    long = np.argsort(-n_blocks, kind="stable")
    more = np.searchsorted(-n_blocks[long], -np.arange(int(n_blocks.max())), side="left")
    for b in range(1, len(more)):
        these = head[long[: more[b]]] + b
        before = place[these - 1]
        passed = np.einsum("ni,nij->nj", into[before], through[before]) @ jump
        into[place[these]] = passed / passed.sum(axis=1, keepdims=True)
    for b in range(len(more) - 1, 0, -1):
        these = head[long[: more[b]]] + b
        after = place[these]
        passed = np.einsum("nij,nj->ni", through[after], out[after]) @ jump.T
        out[place[these - 1]] = passed / passed.sum(axis=1, keepdims=True)
    chance = np.empty_like(weight)
    now = into
    for t in range(int(size[0])):
        n = active[t]
        now = (now[:n] @ jump if t else now) * weight[begin[:n] + t]
        now /= now.sum(axis=1, keepdims=True)
        chance[begin[:n] + t] = now
    for t in range(int(size[0]) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        chance[at] *= out[:n]
        passed = (weight[at] * out[:n]) @ jump.T
        out[:n] = passed / passed.sum(axis=1, keepdims=True)
    return chance / chance.sum(axis=1, keepdims=True)


def train(
    texts: list[str], langs: list[str], rounds: int = ROUNDS, rate: float = 0.3, seed: int = 3, labels: list[str] | None = None, most_pieces: int = PIECES_A_ROUND
) -> Tagger:
    """Maximum likelihood by AdaGrad on sequences of pieces of different documents."""
    tagger = Tagger(sorted(set(langs) | set(labels or ())))
    k = len(tagger.labels)
    number = {lang: i for i, lang in enumerate(tagger.labels)}
    split = [[w for w in text.split() if has_letter(w)] for text in texts]
    cores = [{core_of(w) for w in words} for words in split]
    numbers = [number[lang] for lang in langs]
    tagger.lexicon = lexicons(cores, numbers, k)
    # A document's words must not be in a lexicon because of that document alone.
    others = [lexicons(cores[1 - half :: 2], numbers[1 - half :: 2], k) for half in (0, 1)]
    # Words are told apart by the half they occur in: the other half's lexicon may hold them or not.
    index: dict[tuple[str, int], int] = {}
    pieces = []
    for n, (words, label) in enumerate(zip(split, numbers)):
        ids = [index.setdefault((w, n % 2), len(index)) for w in words]
        pieces += [(np.array(ids[i : i + PIECE]), label) for i in range(0, len(ids), PIECE)]
    if not pieces or k < 2:
        return tagger
    del split, cores
    # Four bytes a slot; words of both halves lie in one array each.
    sizes = np.empty(len(index), dtype=np.int64)
    begins = np.empty(len(index), dtype=np.int64)
    found, total = [], 0
    for half in (0, 1):
        ids = np.array([n for n, (_, h) in enumerate(index) if h == half], dtype=np.int64)
        words = [core_of(w) for w, h in index if h == half]
        at = 0
        for part in in_parts(words):
            slots, these = with_lexicon(part, others[half])
            sizes[ids[at : at + len(part)]] = these
            begins[ids[at : at + len(part)]] = total + np.cumsum(these) - these
            found.append(slots.astype(np.int32))
            total += len(slots)
            at += len(part)
    flat = np.concatenate(found)
    del index, found, others
    rng = np.random.default_rng(seed)
    squares = np.full(tagger.weights.shape, 1e-6, dtype=np.float32)
    move_squares, start_squares = np.full((k, k), 1e-6), np.full(k, 1e-6)
    # Languages weigh alike, however many documents each has.
    share = np.bincount([label for _, label in pieces], minlength=k) / len(pieces)
    odds = np.array([1 / share[label] for _, label in pieces])
    odds /= odds.sum()
    batch = 64 * PIECES
    most = min(len(pieces), most_pieces)
    for _ in range(rounds):
        chosen = rng.choice(len(pieces), most, p=odds)
        for at in range(0, most - PIECES + 1, batch):
            group = chosen[at : at + batch]
            group = group[: len(group) // PIECES * PIECES]
            words = np.concatenate([pieces[g][0] for g in group])
            label = np.concatenate([np.full(len(pieces[g][0]), pieces[g][1]) for g in group])
            lengths = np.array([len(pieces[g][0]) for g in group]).reshape(-1, PIECES).sum(axis=1)
            distinct, place = np.unique(words, return_inverse=True)
            spans = [flat[begins[w] : begins[w] + sizes[w]] for w in distinct]
            used = np.concatenate(spans)
            owner = np.repeat(np.arange(len(distinct)), sizes[distinct])
            emitted = np.stack([np.bincount(owner, tagger.weights[used, i], len(distinct)) for i in range(k)], axis=1)
            chance, moved = forward_backward(emitted[place], lengths, tagger.moves, tagger.start, pairs=True)
            truth = np.eye(k)[label]
            error = chance - truth
            by_word = np.stack([np.bincount(place, error[:, i], len(distinct)) for i in range(k)], axis=1)
            grad = np.stack([np.bincount(used, by_word[owner, i], len(squares)) for i in range(k)], axis=1) / len(lengths)
            squares += grad**2
            tagger.weights -= (rate * grad / np.sqrt(squares)).astype(np.float32)
            inner = np.ones(len(words), dtype=bool)
            inner[np.cumsum(lengths) - lengths] = False
            b = np.flatnonzero(inner)
            move_grad = (moved - truth[b - 1].T @ truth[b]) / len(lengths)
            start_grad = error[~inner].mean(axis=0)
            move_squares += move_grad**2
            start_squares += start_grad**2
            tagger.moves -= rate * move_grad / np.sqrt(move_squares)
            tagger.start -= rate * start_grad / np.sqrt(start_squares)
    return tagger


def fit(df: DataFrame, learns: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, longest: int = LONGEST) -> Tagger:
    """A tagger from a bounded sample of the rows that ``learns`` names, with the languages of all of them."""
    length = F.length(text)
    place = F.pmod(F.xxhash64(key, F.lit(5)), F.greatest(length - longest + 1, F.lit(1))).cast("int") + 1
    part = F.when(length > longest, F.substring(text, place, F.lit(longest))).otherwise(F.col(text))
    rows = df.where(learns & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy(F.col(lang).alias("lang")).count().collect()}  # a row per language
    if not counts:
        return train([], [])
    share = max(1, sample // len(counts))
    # Somewhat more than each language's share by hash, so that the smallest hashes of every language are among them.
    wanted = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, (1.3 * share + 30) / n))])
    drawn = (F.xxhash64(key, F.lit(11)) / float(1 << 64) + 0.5).alias("draw")
    chosen = rows.select(drawn, F.col(lang).alias("lang"), part.alias("text")).where(F.col("draw") <= F.try_element_at(wanted, F.col("lang")))
    # The limit binds only where one id stands on very many rows.
    found = sorted(chosen.orderBy("draw", "lang", "text").limit(int(1.6 * sample) + 60 * len(counts)).collect())
    taken, kept = dict.fromkeys(counts, 0), []
    for r in found:
        if taken[r.lang] < share:
            taken[r.lang] += 1
            kept.append(r)
    return train([r.text for r in kept], [r.lang for r in kept], labels=list(counts))


def predict(df: DataFrame, tagger: Tagger, text: str = "text", drop_text: bool = True) -> DataFrame:
    """``df``, by default without ``text``, with ``lang_pred``, ``score`` and ``n_switches`` (changes of language between words)."""
    kept = [c for c in df.columns if c != text or not drop_text]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_switches", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The task's own: nothing of it stays in the worker when the task ends.
        table = WordTable(tagger.emissions, len(tagger.labels) + 1)
        for batch in slices(batches, text, SLICE):
            table.begin()
            split = [value.split() if value and tagger.labels else [] for value in batch.column(text).to_pylist()]
            n = np.array(list(map(len, split)))
            found = table.look(chain.from_iterable(split), int(n.sum()))
            del split
            names, scores, changes = [UNKNOWN] * len(n), np.zeros(len(n)), np.zeros(len(n), dtype=np.int64)
            filled = np.flatnonzero(n)
            if len(filled):
                rows = table.rows[found]
                letters = rows[:, -1].astype(np.float64)
                chance = marginals(rows[:, :-1], n[filled], tagger.moves, tagger.start)
                begins = np.cumsum(n[filled]) - n[filled]
                counts = np.add.reduceat(letters, begins)
                means = np.add.reduceat(chance * letters[:, None], begins) / np.maximum(counts, 1)[:, None]
                best = means.argmax(axis=1)
                top = chance.argmax(axis=1)
                turns = np.concatenate([[0], top[1:] != top[:-1]]).astype(np.int64)
                turns[begins] = 0
                turned = np.add.reduceat(turns, begins)
                for i, f in enumerate(filled.tolist()):
                    if counts[i]:
                        names[f], scores[f], changes[f] = tagger.labels[best[i]], min(1.0, float(means[i, best[i]])), turned[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores), pa.array(changes)], names=schema.names)

    return df.mapInArrow(run, schema)
