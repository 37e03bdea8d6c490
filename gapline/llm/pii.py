"""Personal information inside free text: found by a sequence model, checked, and replaced by typed placeholders."""

from __future__ import annotations

import math
import random
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.pii_model import Adam, Tagger, encoded, one_thread
from gapline.llm.pii_patterns import OPENER, TYPES, Span, confirmed, labels, roster_pattern
from gapline.staging import materialize

#: Label 0 is "nothing"; type k begins with label 1 + 2 k and goes on with 2 + 2 k.
LABELS = 1 + 2 * len(TYPES)


@dataclass(frozen=True)
class PiiSettings:
    """``sample``: most texts that are labelled for training; ``sample_chars``: most characters of each, a stretch at a place that follows from its id.

    The tagger is trained in ``shards`` tasks, each over its own stretches; after
    each of ``rounds`` rounds of ``steps`` steps the changes of the weights are averaged.
    ``window`` and ``overlap``: characters of the overlapping windows that every sentence or line
    longer than a window is cut into. ``task_chars``: about how many characters a task reads. ``openers``:
    in how many texts a word must begin sentences to be taken for one that often does.
    ``traps``: most stretches without personal information that one sampled text gives; ``stretch``: most
    characters of a labelled stretch. ``memory``: characters of decoded windows that a worker remembers.
    """

    sample: int = 6000
    sample_chars: int = 4000
    hidden: int = 40
    shards: int = 1
    rounds: int = 6
    steps: int = 50
    batch: int = 64
    rate: float = 0.008
    window: int = 256
    overlap: int = 64
    task_chars: int = 3_000_000
    openers: int = 20
    traps: int = 12
    stretch: int = 124
    memory: int = 16_000_000
    seed: int = 11


# --- windows --------------------------------------------------------------------------------------------------------

#: Where a window may end: behind a line's end, or behind a stop before a space.
_END = re.compile(r"[.!?][ \u00a0]+(?=\S)|[\r\n]\s*")
#: Abbreviations of three letters and more that a name, number or street follows.
_SHORT = ("prof", "mrs", "dra", "sra", "srta", "str", "avda", "pza", "apt", "tel")
#: The model takes all digits for one letter, so windows that differ in digits alone are decoded alike.
_DIGITS = str.maketrans("123456789", "0" * 9)

#: A window: start, end, and whether its borders lie inside a sentence.
Window = tuple[int, int, bool, bool]


def _ends(text: str) -> Iterator[int]:
    """Ends of lines that don't end in a comma or colon, and of sentences whose last word is a number or has three letters and isn't an abbreviation."""
    for m in _END.finditer(text):
        at = m.start()
        if text[at] in "\r\n":
            if text[max(0, at - 3) : at].rstrip(" \t")[-1:] not in (",", ":", ";"):
                yield m.end()
            continue
        last = text[max(0, at - 3) : at]
        if last[-2:].isdigit() and len(last) > 1 or len(last) == 3 and last.isalpha() and not text[max(0, at - 4) : at].lower().endswith(_SHORT):
            yield m.end()


def windows_of(text: str, settings: PiiSettings) -> list[Window]:
    """The windows of a whole text: its sentences and lines; those longer than a window as overlapping windows."""
    out: list[Window] = []
    a, hop, size = 0, settings.window - settings.overlap, settings.window
    for b in [*_ends(text), len(text)]:
        if b - a <= size:
            if b > a:
                out.append((a, b, False, False))
        else:
            start = a
            while b - start > size:
                out.append((start, start + size, start > a, True))
                start += hop
            out.append((start, b, start > a, False))
        a = b
    return out


# --- training -------------------------------------------------------------------------------------------------------

_VOWEL_WORDS = ("ba", "be", "bri", "ca", "dor", "den", "el", "fa", "gil", "han", "ir", "ka", "lo", "mer", "nol", "or", "pim", "quo", "rin", "sa", "ta", "ur", "ven", "wil", "yas", "zo", "ti", "mu", "lan", "sto", "gra", "ske", "jo", "vi", "hel", "ran", "dra", "ost", "ull", "ce", "pe", "ño", "lä", "jör", "ü")
_KOREAN_PARTS = "가나다라마바사아자차하늘봄솔샘달별새한결온람이은서준민지현우진윤도빛들"


def _new_word(rng: random.Random) -> str:
    word = "".join(rng.choice(_VOWEL_WORDS) for _ in range(rng.choice((1, 2, 2, 3, 3, 4))))
    return word.capitalize()


def _new_name(rng: random.Random, old: str, known: list[tuple[str, str]]) -> str:
    """Another name of the same shape: words become invented or known ones, initials and commas stay."""
    if re.fullmatch(r"[가-힣]+", old):
        return "".join(rng.choice(_KOREAN_PARTS) for _ in range(max(2, min(5, len(old) + rng.choice((-1, 0, 0, 1))))))

    def word(m: re.Match) -> str:
        w = m.group()
        if w in ("von", "van", "de", "del", "zu") or len(w) == 1:
            return w if len(w) > 1 else rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        new = rng.choice([x for x in rng.choice(known) if x] or [w]) if known and rng.random() < 0.3 else _new_word(rng)
        return new.lower() if w.islower() else new

    return re.sub(r"[^\W\d_]+", word, old)


def _varied(rng: random.Random, text: str, spans: list[Span], known: list[tuple[str, str]]) -> tuple[str, list[Span]]:
    """A copy of a labelled text with other names, digits, mail boxes and perhaps other case."""
    out, made, at = "", [], 0
    for a, b, kind in spans:
        out += text[at:a]
        old = text[a:b]
        if kind == "person_name" and rng.random() < 0.75:
            old = _new_name(rng, old, known)
        elif kind == "email" and rng.random() < 0.5:
            old = re.sub(r"^[A-Za-z]{3,}", lambda m: rng.choice((_new_word(rng).lower(), m.group())), old)
        made.append((len(out), len(out) + len(old), kind))
        out += old
        at = b
    out += text[at:]
    draw = rng.random()
    if draw < 0.12 and len(out.upper()) == len(out):
        out = out.upper()
    elif draw < 0.17 and len(out.lower()) == len(out):
        out = out.lower()
    return out, made


def _tags(text: str, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for a, b, kind in spans:
        k = TYPES.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


Labelled = tuple[str, list[Span]]
#: A stretch without personal information, with the words that might be taken for some.
Other = tuple[str, str]


def training_windows(text: str, roster: re.Pattern | None, trap: re.Pattern, settings: PiiSettings, openers: frozenset[str] = frozenset()) -> tuple[list[Labelled], list[Other]]:
    """Labelled stretches of a text, with and without personal information: its windows, as they are decoded later.

    Those without lie where numbers or words are that might be taken for some
    (``trap``), and at one other place. Texts nearly all in capitals are left
    out, as capitals are made from the others.
    """
    rng = random.Random(settings.seed + len(text))
    letters = [c for c in text if c.isalpha()]
    if letters and sum(c.isupper() for c in letters) > 0.5 * len(letters):
        return [], []
    spans = labels(text, roster, openers)
    some: list[Labelled] = []
    none: list[Other] = []
    quiet: list[tuple[int, int]] = []
    i = 0
    for low, high, inside, _ in windows_of(text, settings):
        if inside and some and low < i:
            low = i
        own = [s for s in spans if low <= s[0] and s[1] <= high]
        if not own:
            if all(s[1] <= low or s[0] >= high for s in spans):
                quiet.append((low, high))
            continue
        j = 0
        while j < len(own):
            # A stretch of a long window begins some characters before a span, else with the window.
            a = low if own[-1][1] - low <= settings.stretch else max(low, own[j][0] - rng.randint(4, 45), own[j - 1][1] if j else 0)
            k = j
            while k + 1 < len(own) and own[k + 1][1] <= a + settings.stretch:
                k += 1
            b = min(high, max(a + settings.stretch, own[k][1]), own[k + 1][0] if k + 1 < len(own) else high)
            if b - a <= settings.stretch:
                some.append((text[a:b], [(x - a, y - a, t) for x, y, t in own[j : k + 1]]))
            low, j = b, k + 1
        i = high
    starts = [a for a, _ in quiet]
    places = [m.start() for m in trap.finditer(text)] + [rng.randint(0, max(0, len(text) - 1))]
    for at in rng.sample(places, min(settings.traps, len(places))):
        q = bisect_right(starts, at) - 1
        if q < 0 or at >= quiet[q][1]:
            continue
        low, high = quiet[q]
        a = low if high - low <= settings.stretch else max(low, at - rng.randint(5, 45))
        b = min(high, a + settings.stretch)
        if b - a > 8:
            none.append((text[a:b], re.sub(r"\d+", "0", text[at : at + 18])))
    return some, none


def trap_pattern(people: list[tuple[str, str]]) -> re.Pattern:
    """Places that look like personal information: longer numbers, capitals inside a sentence, words that are also names."""
    words = sorted({re.escape(w) for p in people for w in p if w})
    either = "|".join([r"\d{5,}", r"\d[\d.-]{5,}\d(?!-\d\d)", r"[a-z,] [A-Z][a-z]+", r"(?:^|[.!?>:] )[A-ZÀ-Þ][\w'’]+ [\w]+"])
    return re.compile(either + (rf"|(?<!\w)(?:{'|'.join(words)})(?!\w)" if words else ""), re.M)


def train_some(model: Tagger, some: list[Labelled], none: list[Other], people: list[tuple[str, str]], settings: PiiSettings, part: int, first: int) -> None:
    """``settings.steps`` steps from step ``first`` on, in place. Rare types and rare kinds of stretches are drawn as often as frequent ones."""
    rng = random.Random(settings.seed * 1_000_003 + part * 1009 + first)
    by_type = {k: [w for w in some if any(s[2] == k for s in w[1])] for k in TYPES}
    kinds = [k for k in TYPES if by_type[k]] + ["person_name"] * (2 if by_type["person_name"] else 0)
    groups: dict[str, list[Labelled]] = {}
    for text, words in none:
        groups.setdefault(words, []).append((text, []))
    others = list(groups.values())
    if not kinds and not others:
        return
    adam, total = Adam(model.w), settings.steps * settings.rounds
    for step in range(first, first + settings.steps):
        rows = []
        for _ in range(settings.batch):
            if kinds and (not others or rng.random() < 0.52):
                drawn = rng.choice(by_type[rng.choice(kinds)])
            else:
                drawn = rng.choice(rng.choice(others)) if rng.random() < 0.5 else (rng.choice(none)[0], [])
            rows.append(_varied(rng, *drawn, people))
        code, kind, words, mask = encoded([t for t, _ in rows])
        gold = np.zeros(code.shape, np.int64)
        for i, (text, spans) in enumerate(rows):
            gold[: len(text), i] = _tags(text, spans)
        _, grads = model.gradients(code, kind, words, gold, mask)
        rate = settings.rate * min(1.0, (step - first + 1) / 10) * (1.0 if step < total * 0.4 else max(0.06, (1 - step / total) / 0.6))
        adam.step(model.w, grads, rate)


# --- decoding -------------------------------------------------------------------------------------------------------


def _spans_of(path: np.ndarray, gain: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Spans (start, end, type, score) of one label path. ``gain``: by how much each character's label beats "nothing"."""
    out = []
    edges = np.flatnonzero(path)
    if not len(edges):
        return out
    kinds = (path - 1) // 2
    start = edges[0]
    for i, e in enumerate(edges):
        if i and (e != edges[i - 1] + 1 or kinds[e] != kinds[start] or path[e] % 2 == 1):
            out.append((int(start), int(edges[i - 1]) + 1, int(kinds[start]), float(gain[start : edges[i - 1] + 1].sum())))
            start = e
    out.append((int(start), int(edges[-1]) + 1, int(kinds[start]), float(gain[start : edges[-1] + 1].sum())))
    return out


def _reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The set of spans without overlaps that has the highest total score, over the whole text."""
    if len(spans) < 2:
        return spans
    spans = sorted(set(spans), key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]
    before = np.searchsorted(ends, [s[0] for s in spans], side="right")
    for i, s in enumerate(spans):
        take = best[before[i]][0] + s[3]
        best.append((take, i) if take > best[i][0] else (best[i][0], -1))
    out, i = [], len(spans)
    while i:
        if best[i][1] >= 0:
            out.append(spans[i - 1])
            i = int(before[i - 1])
        else:
            i -= 1
    return out[::-1]


def decode(model: Tagger, pieces: list[str], batch: int = 384) -> list[tuple[tuple[int, int, int, float], ...]]:
    """The spans (start, end, type, score) of each window."""
    found: list[tuple[tuple[int, int, int, float], ...]] = [()] * len(pieces)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    table = model.table() if pieces else None
    for lo in range(0, len(order), batch):
        rows = order[lo : lo + batch]
        code, kind, words, _ = encoded([pieces[i] for i in rows])
        scores = model.scores(code, kind, words, table)
        paths = model.best_paths(scores)
        for j in np.flatnonzero((paths > 0).any(0)):
            n = len(pieces[rows[j]])
            path = paths[:n, j]
            found[rows[j]] = tuple(_spans_of(path, scores[np.arange(n), j, path] - scores[:n, j, 0]))
    return found


#: What this process has decoded with a model: window -> spans.
_DECODED: dict[str, dict[str, tuple[tuple[int, int, int, float], ...]]] = {}


def _remembered(model: Tagger, settings: PiiSettings) -> dict[str, tuple[tuple[int, int, int, float], ...]]:
    """What is known of this model's windows; the oldest are forgotten beyond ``settings.memory`` characters."""
    if not model.key:
        return {}
    if model.key not in _DECODED:
        _DECODED.clear()
    known = _DECODED.setdefault(model.key, {})
    over = sum(map(len, known)) - settings.memory
    for piece in list(known) if over > 0 else ():
        if over <= 0:
            break
        over -= len(piece)
        del known[piece]
    return known


def find_in(model: Tagger, texts: list[str], settings: PiiSettings = PiiSettings()) -> list[list[Span]]:
    """The checked spans of each whole text.

    Windows that look the same to the model are decoded once, here and in later
    calls of this process: the same codes give the same path.
    """
    known = _remembered(model, settings)
    cut: list[list[Window]] = []
    folded: list[str] = []
    todo: dict[str, None] = {}
    for text in texts:
        seen = text.translate(_DIGITS)
        windows = windows_of(text, settings)
        cut.append(windows)
        folded.append(seen)
        for a, b, _, _ in windows:
            piece = seen[a:b]
            if piece not in known:
                todo[piece] = None
    fresh = list(todo)
    known.update(zip(fresh, decode(model, fresh)))
    out: list[list[Span]] = []
    for text, seen, windows in zip(texts, folded, cut):
        spans: list[tuple[int, int, int, float]] = []
        for a, b, first, last in windows:
            for s, e, k, score in known[seen[a:b]]:
                # A span cut by a window's border is whole in the neighbour, unless it is longer than the overlap.
                across = (s == 0 and first) or (e == b - a and last)
                spans.append((a + s, a + e, k, 0.1 * score if across else score + 1e-3))
        kept: dict[tuple[int, int], str] = {}
        for s, e, k, _ in _reconciled(spans):
            kind = TYPES[k]
            if kind == "person_name" and (mail := confirmed(text, s, e, "email")) and mail[0] <= s and e <= mail[1]:
                kind = "email"  # a name inside of an address
            exact = confirmed(text, s, e, kind, model.openers, model.given)
            if exact and all(exact[1] <= a or exact[0] >= b for a, b in kept):
                kept[exact] = kind
        out.append(sorted((a, b, k) for (a, b), k in kept.items()))
    return out


# --- operator -------------------------------------------------------------------------------------------------------


def sampled(df: DataFrame, ident: str, text: str, settings: PiiSettings) -> DataFrame:
    """The bounded sample to be labelled: ``h``, ``cut``, of the texts with the smallest hashes of their ids."""
    shift = F.pmod(F.xxhash64(F.col(ident), F.lit(2)), F.greatest(F.length(text) - settings.sample_chars + 1, F.lit(1)))
    cut = F.substring(F.col(text), (shift + 1).cast("int"), F.lit(settings.sample_chars))
    sample = df.where(F.length(text) > 0).select(F.xxhash64(ident).alias("h"), cut.alias("cut")).orderBy("h", "cut").limit(settings.sample)
    return materialize(sample, "sample")


def people_in(sample: DataFrame, roster: DataFrame) -> list[tuple[str, str]]:
    """Given and family names of the whole roster, each by itself, whose words all occur in the sample.

    The roster may be of any size: what is gathered is bounded by the words of the sample.
    """
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}]+"), lambda w: w != ""))
    words = sample.select(F.explode(split(F.col("cut"))).alias("word")).distinct()
    names = roster.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col(c).alias("name")) for i, c in enumerate(("given_name", "family_name"))))).alias("n")).select("n.part", "n.name").where("name is not null").distinct()
    spelt = names.withColumn("words", split(F.col("name"))).where("size(words) > 0").withColumn("size", F.size("words"))
    seen = spelt.select("part", "name", "size", F.explode("words").alias("word")).join(words, "word", "left_semi")
    whole = seen.groupBy("part", "name", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    return sorted((r.name, "") if r.part == 0 else ("", r.name) for r in whole.collect())


def training_rows(df: DataFrame, ident: str, text: str, people: list[tuple[str, str]], settings: PiiSettings, sample: DataFrame | None = None) -> tuple[DataFrame, frozenset[str]]:
    """Labelled stretches of the sample: ``part``, ``text``, ``spans``, ``words``.

    Also the words that begin sentences in more than one of 400 of all texts, read whole, and in ``settings.openers`` at
    least: no more than 400 times the mean number of such words in a text.
    """
    sample = sampled(df, ident, text, settings) if sample is None else sample
    whole = df.where(F.length(text) > 0)
    first = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(OPENER), F.lit(1)))
    words = whole.select(F.explode(first).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    often = (F.col("n") * 400 > whole.count()) & (F.col("n") >= settings.openers)
    openers = frozenset(unicodedata.normalize("NFC", r[0]) for r in words.where(often).collect())
    roster, trap = roster_pattern(people), trap_pattern(people)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, t in zip(pdf["h"], pdf["cut"]):
                some, none = training_windows(t, roster, trap, settings, openers)
                rows += [(int(h) % settings.shards, w, [{"a": a, "b": b, "k": k} for a, b, k in s], "") for w, s in some]
                rows += [(int(h) % settings.shards, w, [], words) for w, words in none]
            yield pd.DataFrame(rows, columns=["part", "text", "spans", "words"])

    stretches = sample.repartition(settings.shards * 2, "h").mapInPandas(windows, "part int, text string, spans array<struct<a:int,b:int,k:string>>, words string")
    return materialize(stretches, "stretches"), openers


def _round(held, stretches, names: list[str], settings: PiiSettings, r: int):
    """What a task does in one round: train on its stretches from the common weights, and return its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for pdf in batches:
            for part in pdf["id"]:
                weights, known = held.value
                local = Tagger(LABELS, settings.hidden, settings.seed)
                local.w = {k: v.copy() for k, v in weights.items()}
                some, none = stretches.value.get(int(part), ([], []))
                if some or none:
                    train_some(local, some, none, known, settings, int(part), r * settings.steps)
                    yield pd.DataFrame({"part": [int(part)], "weights": [b"".join(local.w[k].astype(np.float32).tobytes() for k in names)]})

    return run


def fit(df: DataFrame, ident: str, text: str, roster: DataFrame, settings: PiiSettings = PiiSettings()) -> Tagger:
    """A tagger for these texts, trained on labelled stretches of a sample.

    ``roster`` has ``given_name`` and ``family_name``, of any number of people: of
    the whole roster those names are used that occur in the sample. The same texts, however distributed, give the same tagger but for the
    order in which floating point numbers are added. Without a single labelled
    stretch the tagger is untrained, which the checks of its spans make harmless.
    """
    sample = sampled(df, ident, text, settings)
    people = people_in(sample, roster)
    rows, openers = training_rows(df, ident, text, people, settings, sample)
    model = Tagger(LABELS, settings.hidden, settings.seed)
    model.openers, model.given = openers, frozenset(g.lower() for g, _ in people if g)
    names = sorted(model.w)
    # A bounded table (sampled texts, characters and traps), sent to the tasks once.
    by_part: dict[int, tuple[list, list]] = {}
    for x in rows.collect():
        some, none = by_part.setdefault(x.part, ([], []))
        some.append((x.text, tuple((s.a, s.b, s.k) for s in x.spans))) if x.spans else none.append((x.text, x.words))
    for some, none in by_part.values():
        some.sort()
        none.sort()
    stretches = df.sparkSession.sparkContext.broadcast(by_part)
    tasks = df.sparkSession.range(0, settings.shards, 1, settings.shards)
    for r in range(settings.rounds):
        held = df.sparkSession.sparkContext.broadcast((model.w, people))
        parts = sorted(tasks.mapInPandas(_round(held, stretches, names, settings, r), "part int, weights binary").collect())
        if not parts:
            break
        old = np.concatenate([model.w[k].ravel() for k in names])
        moves = np.stack([np.frombuffer(p.weights, np.float32) for p in parts]) - old
        # A weight is averaged over the parts that moved it: rare words are seen by few.
        mean = old + moves.sum(0) / np.maximum((moves != 0).sum(0), 1)
        at = 0
        for k in names:
            n = model.w[k].size
            model.w[k] = mean[at : at + n].reshape(model.w[k].shape).astype(np.float32)
            at += n
    model.key = uuid.uuid4().hex
    return model


def _parts(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in lists of about so many characters."""
    part: list[str] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def _replaced(text: str, spans: list[Span]) -> str:
    """The text with a placeholder for each span."""
    pieces, at = [], 0
    for a, b, k in spans:
        pieces += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*pieces, text[at:]])


SPANS = "array<struct<pii_type:string,char_start:int,char_end:int>>"


def with_pii(df: DataFrame, text: str, model: Tagger, settings: PiiSettings = PiiSettings(), out: str = "pii", redacted: str | None = "redacted") -> DataFrame:
    """``df`` with the spans found in each whole text, and the text with a placeholder such as [EMAIL] for each.

    ``out`` is an array of (pii_type, char_start, char_end), in Unicode
    characters from 0, in order and without overlaps; ``redacted`` has all else
    unchanged, line ends and accents included. Null texts give an empty array
    and null; empty ones an empty array and an empty text. Columns of ``df`` named
    like the new ones are replaced. Texts of any length are read whole, in
    windows; each occurrence of a repeated text is treated alike. Without
    ``redacted`` only the spans are made.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one_thread()
        for texts in batches:
            all_spans, new = [], []
            for part in _parts([t if isinstance(t, str) else "" for t in texts], settings.task_chars):
                for t, spans in zip(part, find_in(held.value, part, settings)):
                    all_spans.append([{"pii_type": k, "char_start": a, "char_end": b} for a, b, k in spans])
                    if redacted:
                        new.append(_replaced(t, spans))
            yield pd.DataFrame({"spans": all_spans, "text": new if redacted else None})

    # Tasks of about as many characters each; a filter on the result must not make the model read a text twice.
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / settings.task_chars))
    found = F.pandas_udf(find, f"struct<spans:{SPANS},text:string>").asNondeterministic()(F.col(text))
    read = df.repartition(tasks).withColumn("__pii", found)
    if redacted:
        read = read.withColumn(redacted, F.when(F.col(text).isNotNull(), F.col("__pii.text")))
    return read.withColumn(out, F.col("__pii.spans")).drop("__pii")
