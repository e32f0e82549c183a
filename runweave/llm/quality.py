"""Per-document text statistics, and what kind of text a document is.

A batch's texts are one array of code points. Lines, words, their hashes, word classes and character
classes are array operations over it. A text is cut into segments of neighbouring lines (blank lines
part segments, and about ``window`` characters end one); each segment has four distributions:
word classes (kinds of function words of each language, content words, numbers, signs), how
function and content words follow one another, character classes, and characters by the kind of their line (item, short, repeated, other). The segment takes the
profile that is nearest by Jensen-Shannon divergence; profiles are those of prose in each language and of other
structures (lists of names, tables, records, encoded data, signs, shuffled words, items, short lines, repetition).

A segment that is nearest to no prose, and in which few words are function words of the four languages, may be prose in another one. It is rated by
what any language shows: the forms of words, how short and other words follow one another, where marks stand, characters and lines. Those profiles are measured by
this module on public text in further languages and scripts, and on what ``samples.structures`` makes from it by rule.

A document whose characters lie for less than half in segments of prose is not natural prose; no other rule decides.

Edge cases: null and empty texts have all counts 0, null shares and profile 'empty', and are no prose but
not reported as a case; meaningless words in an unknown language that look like prose pass for it; texts of any length are
read whole; repeated documents are rated alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm import samples
from runweave.llm.arrowtext import string_buffers, to_codes
from runweave.llm.plainform import TOP

DET, PREP, CONJ, PRON, AUX, ADV, CONTENT, MIXED, NUMBER, SIGNS = range(10)
# The function words of each language by kind.
FUNCTION_WORDS = {
    "en": (
        "the a an this these those no every its his her their our my your",
        "of in to for with on at from by about as into through after over between out against during without before under around among until since near behind beside beyond towards upon off along across above below than like per",
        "and or but if because although though while when where whether so yet nor unless which who whom whose what why how either neither once",
        "i you he she it we they me him us them that who itself himself themselves myself one everyone nobody somebody everything nothing something anyone there some any each all both another such many few most more much several other",
        "is was are were be been being has have had do does did will would can could should may might must shall don t s ve re ll d isn wasn didn doesn won",
        "not very too only just also then now here again never always still already even almost rather up down back away together later soon ever often first last well far long",
    ),
    "de": (
        "der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner dieser diese dieses diesen diesem jeder jede jedes alle allen viele einige mehr sein seine seinen ihr ihre ihren unser unsere mein meine",
        "in im an am auf aus bei beim mit nach von vom vor zu zum zur für über unter zwischen durch gegen ohne um seit während bis hinter neben ab trotz wegen",
        "und oder aber weil dass da wenn als ob wie denn sondern doch damit obwohl bevor nachdem sobald deren dessen wo wer was warum",
        "ich du er sie es wir man mich mir dich dir sich uns ihn ihm ihnen euch niemand jemand alles nichts etwas",
        "ist war sind waren sei wäre hat hatte haben hatten wird wurde wurden werden worden geworden kann konnte können konnten muss musste soll sollte sollten will wollte wollten darf mag",
        "nicht auch nur noch schon sehr so dann hier dort immer wieder nie mehr ganz bereits eben gerade kaum bald später genau fast daher heute",
    ),
    "es": (
        "el la los las un una unos unas este esta estos estas ese esa aquel aquella aquellos su sus mi tu nuestro nuestra todo toda todos todas cada otro otra otros otras algún ningún ninguna mucho muchos poco",
        "de del a al en con por para sin sobre entre desde hasta hacia tras ante bajo según durante contra",
        "y e o u pero que porque si cuando como donde mientras aunque sino ni pues quien cual cuyo",
        "yo tú él ella ello nosotros ellos ellas se me te nos lo le les mí nadie alguien algo nada quién qué eso esto",
        "es era son eran fue fueron ser sido está estaba están estar ha había han habían haber he hay hubo tiene tenía puede podía debe quiso quería va",
        "no ya más muy también solo sólo casi aún todavía siempre nunca bien mal así ahora aquí allí luego después antes menos tan tanto bastante",
    ),
    "fr": (
        "le la les l un une des du ce cet cette ces son sa ses mon ma mes ton notre nos leur leurs votre tout toute tous toutes chaque autre autres quelque quelques aucun aucune plusieurs",
        "de d à au aux en dans par pour sur sous avec sans entre vers chez après avant depuis pendant contre jusqu dès malgré afin",
        "et ou mais que qu car si quand comme lorsque puisque donc ni où dont qui parce tandis quoi",
        "je j tu il elle on nous vous ils elles se s me m te t lui y eux personne rien quelqu cela ça c",
        "est était sont étaient être été a avait ont avaient avoir ai sera serait fut peut pouvait doit devait fait faut va voulu",
        "ne n pas plus très aussi bien déjà encore toujours jamais alors ici là puis trop peu seulement presque moins même tard directement",
    ),
}
#: Structures: word classes (in the order above), follow-on classes (a determiner before what is no part of its group or two prepositions and the like, other function before
#: function, function before content, content before function, content before content) and
#: character classes (letters, digits, blanks, sentence marks, other signs, line ends).
PROFILES = {
    "names": ((0.05, 0.03, 0.02, 0.005, 0.01, 0.01, 0.81, 0.005, 0.05, 0.01), (0.002, 0.01, 0.10, 0.08, 0.808), (0.79, 0.03, 0.14, 0.03, 0.005, 0.005)),
    "list": ((0.04, 0.03, 0.01, 0.005, 0.01, 0.005, 0.55, 0.005, 0.16, 0.185), (0.002, 0.01, 0.09, 0.08, 0.818), (0.60, 0.08, 0.18, 0.05, 0.06, 0.03)),
    "words": ((0.0, 0.0, 0.0, 0.0, 0.0, 0.01, 0.94, 0.005, 0.035, 0.01), (0.0, 0.0, 0.01, 0.01, 0.98), (0.82, 0.02, 0.13, 0.005, 0.005, 0.02)),
    "table": ((0.02, 0.02, 0.005, 0.005, 0.005, 0.005, 0.48, 0.01, 0.20, 0.25), (0.001, 0.01, 0.06, 0.06, 0.869), (0.52, 0.11, 0.22, 0.04, 0.09, 0.02)),
    "records": ((0.01, 0.01, 0.005, 0.005, 0.005, 0.015, 0.42, 0.01, 0.17, 0.35), (0.001, 0.01, 0.04, 0.04, 0.909), (0.54, 0.13, 0.08, 0.07, 0.16, 0.02)),
    "encoded": ((0.0, 0.0, 0.0, 0.01, 0.01, 0.0, 0.12, 0.56, 0.22, 0.08), (0.0, 0.01, 0.04, 0.04, 0.91), (0.81, 0.145, 0.0, 0.0, 0.03, 0.015)),
    "signs": ((0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.02, 0.0, 0.02, 0.96), (0.0, 0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.01, 0.2, 0.75, 0.04)),
    "shuffled": ((0.10, 0.30, 0.08, 0.10, 0.14, 0.0, 0.275, 0.003, 0.001, 0.001), (0.20, 0.34, 0.19, 0.19, 0.08), (0.79, 0.0, 0.205, 0.002, 0.002, 0.001)),
    "scrambled": ((0.06, 0.02, 0.01, 0.05, 0.02, 0.02, 0.64, 0.06, 0.02, 0.10), (0.01, 0.05, 0.15, 0.15, 0.64), (0.76, 0.01, 0.16, 0.03, 0.03, 0.01)),
}
LANGUAGES = list(FUNCTION_WORDS)
#: Visible characters by the line they stand in: an item (bulleted and under twelve words), under three words and not closed by a mark, as
#: before in the document, any other. Lists and repetition are profiles of their own.
LINES = {"prose": (0.01, 0.04, 0.02, 0.93), "names": (0.05, 0.1, 0.05, 0.8), "list": (0.3, 0.3, 0.05, 0.35), "items": (0.85, 0.05, 0.02, 0.08), "short lines": (0.02, 0.88, 0.02, 0.08), "repeated": (0.02, 0.04, 0.9, 0.04)}
#: Prose in which four words in ten belong to names and titles, and the words of prose in items, in lines of one or two words, and said again and again.
MADE = ("prose", "prose with names", "items", "short lines", "repeated")
NAMES = [*PROFILES, *(f"{kind} {lang}" for lang in LANGUAGES for kind in MADE)]
RATED = list(NAMES)
#: Prose in a language without a profile of its own.
OTHER_PROSE = len(NAMES)
NAMES = [*NAMES, "prose other"]
PROSE = np.array([n.startswith("prose") for n in NAMES])
#: Segments with a smaller share of known function words than this are looked at by their forms alone.
FOREIGN_SHARE = 0.25
_LENGTH = 16
_PRIME = np.uint64(1_099_511_628_211)
_POWERS = np.array([pow(int(_PRIME), k, 2**64) for k in range(_LENGTH)], np.uint64)
BULLETS = "-*•·–—‣▪◦"
#: Signs that close a line.
CLOSING = ".!?…:;\"”»"
SENTENCE_MARKS = ".,;:!?'\"()-’“”«»¿¡…–。、，！？；：「」『』،؛؟।॥·"
#: Marks that stand behind a word and before a blank.
STOPS = ".,;:!?…。，、；：！？،؛؟।॥"
#: Marks behind which a capital letter begins a sentence.
SENTENCE_ENDS = ".!?…:。！？؟।"


def _hash(word: str) -> int:
    return int(sum(np.uint64(ord(c)) * _POWERS[k] for k, c in enumerate(word[:_LENGTH])) & np.uint64(2**64 - 1)) if word else 0


@cache
def _tables() -> tuple:
    """Lower case, letter, upper case, digit and character class of every code point; function words by hash."""
    low = np.arange(TOP, dtype=np.uint32)
    kind = np.full(TOP, 4, np.int8)
    upper = np.zeros(TOP, bool)
    for cp in range(0x32400):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        k = unicodedata.category(c)
        if k[0] in "LM":
            kind[cp] = 0
            if len(x := c.lower()) == 1:
                low[cp] = ord(x)
            upper[cp] = k in ("Lu", "Lt")
        elif k[0] == "N":
            kind[cp] = 1
        elif c.isspace():
            kind[cp] = 2
    for c in SENTENCE_MARKS:
        kind[ord(c)] = 3
    kind[10] = 5
    with np.errstate(over="ignore"):
        of: dict[int, list[int]] = {}
        for i, lang in enumerate(LANGUAGES):
            for k, text in enumerate(FUNCTION_WORDS[lang]):
                for w in text.split():
                    of.setdefault(_hash(w), [CONTENT] * len(LANGUAGES))
                    if of[_hash(w)][i] == CONTENT:
                        of[_hash(w)][i] = k
    marks = np.zeros(TOP, np.uint8)
    for bit, text in ((1, SENTENCE_ENDS), (2, STOPS), (4, CLOSING)):
        marks[[ord(c) for c in text]] |= bit
    keys = np.array(sorted(of), np.uint64)
    classes = np.array([of[int(k)] for k in keys], np.int8)
    return low, kind, upper, marks, keys, classes


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from each row of q: rows of p by rows of q."""
    m = (p[:, None, :] + q[None, :, :]) / 2
    return _entropy(m) - (_entropy(p)[:, None] + _entropy(q)[None, :]) / 2


def _entropy(x: np.ndarray) -> np.ndarray:
    return -np.einsum("...i,...i", x, np.log2(x + 1e-300))


def _nearest_is_prose(shares: list[np.ndarray], profiles: list[np.ndarray], is_prose: np.ndarray, quick: tuple[int, ...]) -> np.ndarray:
    """Whether the nearest profile by the sum of all divergences is one of prose. The others are first compared by the short
    distributions alone (``quick``); where that sum is no less than the nearest prose, the rest cannot bring them nearer."""
    best = sum(divergence(x, y[is_prose]) for x, y in zip(shares, profiles)).min(axis=1)
    low = sum(divergence(shares[i], profiles[i][~is_prose]) for i in quick)
    s, k = np.nonzero(low < best[:, None])
    total = low[s, k]
    for i in range(len(shares)):
        if i not in quick:
            x, y = shares[i][s], profiles[i][~is_prose][k]
            total = total + _entropy((x + y) / 2) - (_entropy(x) + _entropy(y)) / 2
    out = np.ones(len(best), bool)
    out[s[total < best[s]]] = False
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    """Rows to shares; a row without counts is even."""
    total = counts.sum(axis=1, keepdims=True)
    return np.where(total > 0, counts / np.maximum(total, 1), 1 / counts.shape[1])


def _without_tags(text: np.ndarray, k: np.ndarray, longest: int = 60) -> np.ndarray:
    """Kinds with markup tags (from < before a letter or slash to the next > nearby) as blanks."""
    opens = np.flatnonzero(text == 60)
    closes = np.flatnonzero(text == 62)
    if not (opens.size and closes.size):
        return k
    after = text[np.minimum(opens + 1, len(text) - 1)]
    opens = opens[(after == 47) | ((k[np.minimum(opens + 1, len(text) - 1)] == 0) & (after < 128))]
    nxt = np.searchsorted(closes, opens)
    opens, nxt = opens[nxt < len(closes)], nxt[nxt < len(closes)]
    ends = closes[nxt]
    near = ends - opens <= longest
    step = np.zeros(len(text) + 1, np.int32)
    np.add.at(step, opens[near], 1)
    np.add.at(step, ends[near] + 1, -1)
    inside = (np.cumsum(step[:-1]) > 0) & (k != 5)
    return np.where(inside, 2, k).astype(np.int8)


def _bullets(text: np.ndarray, k: np.ndarray, seen: np.ndarray, line: np.ndarray, n_lines: int) -> np.ndarray:
    """Whether each line begins with a bullet and a blank."""
    at = np.flatnonzero(seen)
    out = np.zeros(n_lines, bool)
    if at.size:
        lead = at[np.concatenate([[True], line[at][1:] != line[at][:-1]])]
        mark = np.isin(text[lead], np.array([ord(c) for c in BULLETS], np.uint32)) & (k[np.minimum(lead + 1, len(k) - 1)] == 2)
        out[line[lead[mark]]] = True
    return out


SHORT, MIDDLE, LONG_WORD, BEGIN, CAPITAL, CAPITALS, DIGITS, MIXED_FORM, OTHER_SIGNS = range(9)


def _forms(seg: np.ndarray, n_segs: int, length: np.ndarray, first_up: np.ndarray, ups: np.ndarray, number: np.ndarray, mixed: np.ndarray, begins: np.ndarray, signs: np.ndarray, stopped: np.ndarray) -> list[np.ndarray]:
    """Counts of word forms, of short and other words in a row, and of words by their marks, of each segment: what can be said of a text in any language.

    Words are short (three letters at most, in lower case or without case), of middle length, long, with a capital at the begin of a sentence, with
    one elsewhere, in capitals, numbers, mixed; runs of signs come beside. ``stopped``: 0 with a mark behind, 1 with one right before, 2 with none."""
    c = np.select([mixed, number, (ups > 1) & (ups == length), first_up & begins, first_up, length <= 3, length <= 7], [MIXED_FORM, DIGITS, CAPITALS, BEGIN, CAPITAL, SHORT, MIDDLE], LONG_WORD)
    counts = np.bincount(seg * 9 + c, minlength=n_segs * 9).reshape(n_segs, 9)
    counts[:, OTHER_SIGNS] = signs
    short = (c == SHORT).astype(np.int64)
    both = seg[1:] == seg[:-1]
    follow = np.bincount((seg[:-1] * 4 + short[:-1] * 2 + short[1:])[both], minlength=n_segs * 4).reshape(n_segs, 4) if len(seg) else np.zeros((n_segs, 4), np.int64)
    return [counts, follow, np.bincount(seg * 3 + stopped, minlength=n_segs * 3).reshape(n_segs, 3)]


@cache
def _targets() -> list[np.ndarray]:
    """The distributions of every profile: words, their order, characters, lines. Those of prose are measured on the samples like any text."""
    rows: dict[str, tuple] = {k: (*v, LINES["prose" if k in ("shuffled", "scrambled", "words", "encoded", "signs") else "list" if k == "list" else "names"]) for k, v in PROFILES.items()}
    for lang in LANGUAGES:
        counts = _measured(pa.array([samples.KNOWN[lang]], pa.string()), 10**9)[2]
        prose = [(0.97 * _shares(x.sum(axis=0, keepdims=True)) + 0.03 / x.shape[1])[0] for x in counts]
        rows[f"prose {lang}"] = (*prose, LINES["prose"])
        rows[f"prose with names {lang}"] = (*[0.6 * x + 0.4 * np.array(y) for x, y in zip(prose, PROFILES["names"])], LINES["prose"])
        for kind in ("items", "short lines", "repeated"):
            rows[f"{kind} {lang}"] = (*prose, LINES[kind])
    out = [np.array([rows[x][i] for x in RATED], float) for i in range(4)]
    return [x / x.sum(axis=1, keepdims=True) for x in out]


@cache
def _any_language() -> tuple[list[np.ndarray], np.ndarray]:
    """Distributions of forms, of their order, of marks, of characters and of lines of prose in each language of the samples and of what is made from it by rule,
    measured like any text; and which of them are prose."""
    texts, prose = [], []
    for text in samples.PROSE.values():
        texts.append(text)
        prose.append(True)
        for made in samples.structures(text).values():
            texts.append(made)
            prose.append(False)
    # Without blank lines in it, each text is one segment.
    parts = _measured(pa.array(texts, pa.string()), 10**9)[1]
    # A few counts of the even distribution, as the samples are short.
    even = lambda x: (_shares(x) * 0.98 + 0.02 / x.shape[1])
    return [even(p) for p in parts], np.array(prose)


def measure(col: pa.Array, window: int = 400) -> dict[str, np.ndarray]:
    """All figures of each row of a string column."""
    return _measured(col, window, rate=True)[0]


def _measured(col: pa.Array, window: int, rate: bool = False) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The figures of each row where ``rate`` asks for them, and counts of forms, their order, marks, characters and lines of each segment."""
    low, kind, upper, marks, keys, classes = _tables()
    codes, at = to_codes(*string_buffers(col))
    n_docs = len(at) - 1
    # A line end after each text.
    size = np.diff(at)
    ends = at[1:] + np.arange(n_docs)
    text = np.full(len(codes) + n_docs, 10, np.uint32)
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = codes
    text[text == 13] = 32
    doc = np.repeat(np.arange(n_docs), size + 1)
    k, mark = kind[text], marks[text]
    n = len(text)
    k = _without_tags(text, k)
    # Lines.
    is_end = k == 5
    line = np.cumsum(is_end) - is_end
    line_end = np.flatnonzero(is_end)
    n_lines = len(line_end)
    line_doc = doc[line_end]
    seen = (k != 2) & ~is_end
    visible = np.bincount(line[seen], minlength=n_lines)
    full = visible > 0
    # Segments: blank lines and texts part blocks; within a block every window of characters.
    block = np.cumsum(~full | np.concatenate([[True], line_doc[1:] != line_doc[:-1]]))
    before = np.cumsum(visible) - visible
    first = np.concatenate([[True], block[1:] != block[:-1]])
    base = np.maximum.accumulate(np.where(first, before, 0))
    part = (before - base) // window
    fresh = first | np.concatenate([[True], part[1:] != part[:-1]])
    seg_of_line = np.cumsum(fresh) - 1
    n_segs = int(seg_of_line[-1]) + 1 if n_lines else 0
    seg_doc = line_doc[fresh]
    seg = seg_of_line[line]
    chars = np.bincount(seg * 6 + k, minlength=n_segs * 6).reshape(n_segs, 6)
    # Tokens: runs of letters and digits; runs of other signs that are no sentence marks, each a token.
    alnum = k <= 1
    start = alnum & ~np.concatenate([[False], alnum[:-1]])
    s = np.flatnonzero(start)
    n_words = len(s)
    word = np.cumsum(start) - 1
    a = np.flatnonzero(alnum)
    w = word[a]
    pos = a - s[w] if n_words else a
    with np.errstate(over="ignore"):
        value = low[text[a]].astype(np.uint64) * np.where(pos < _LENGTH, _POWERS[np.minimum(pos, _LENGTH - 1)], np.uint64(0))
        h = np.add.reduceat(value, np.flatnonzero(start[a])) if n_words else np.empty(0, np.uint64)
    length = np.bincount(w, minlength=n_words)
    digits = np.bincount(w[k[a] == 1], minlength=n_words)
    up = upper[text[a]]
    ups = np.bincount(w[up], minlength=n_words)
    first_up = np.zeros(n_words, bool)
    first_up[w[up & (pos == 0)]] = True
    mixed = ((ups > first_up) & (ups < length - digits)) | ((digits > 0) & (digits < length) & (length > 4))
    number = (digits == length) | ((digits > 0) & ~mixed)
    found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    known = (keys[found] == h) & (length <= _LENGTH) if n_words else np.empty(0, bool)
    sign = (k == 4) & ~np.concatenate([[False], (k[1:] == 4) & (k[:-1] == 4)])
    word_seg = seg[s]
    word_doc = doc[s]
    # Lines that stand in the document before, by a hash of their characters.
    with np.errstate(over="ignore"):
        rank = np.arange(n) - np.concatenate([[0], line_end[:-1] + 1])[line] if n_lines else np.empty(0, np.int64)
        mix = (low[text].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * ((rank.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _PRIME)
        mix ^= mix >> np.uint64(29)
        line_hash = np.add.reduceat(mix, np.concatenate([[0], line_end[:-1] + 1])) if n_lines else np.empty(0, np.uint64)
    order = np.lexsort((line_hash, line_doc))
    again = np.zeros(n_lines, bool)
    if n_lines > 1:
        x, y = order[1:], order[:-1]
        again[x] = (line_doc[x] == line_doc[y]) & (line_hash[x] == line_hash[y]) & full[x]
    # The last sign of each line that is not blank.
    last = np.maximum.accumulate(np.where(seen, np.arange(n), -1))[line_end] if n_lines else np.empty(0, np.int64)
    closed = full & (mark[np.maximum(last, 0)] & 4 > 0)
    words_in_line = np.bincount(line[s], minlength=n_lines)
    item = _bullets(text, k, seen, line, n_lines) & (words_in_line < 12)
    line_kind = np.select([again, item, (words_in_line < 3) & ~closed], [2, 0, 1], 3)
    by_line = np.bincount(seg_of_line * 4 + line_kind, weights=visible, minlength=n_segs * 4).reshape(n_segs, 4)
    # Whether a sentence, line or segment ends before each word.
    ends_sentence = (mark & 1 > 0) | is_end
    ended = np.cumsum(ends_sentence)
    begins = np.ones(n_words, bool)
    if n_words > 1:
        begins[1:] = ended[s[1:]] > ended[s[:-1]]
    signs = np.bincount(seg[np.flatnonzero(sign)], minlength=n_segs)
    stop = mark & 2 > 0
    behind, before = s + length, s - 1
    blank = (k == 2) | (k == 5)
    marked = stop[np.minimum(behind, n - 1)] if n_words else np.empty(0, bool)
    leading = stop[np.maximum(before, 0)] & (blank[np.maximum(before - 1, 0)] | (before < 1)) & (before >= 0) if n_words else np.empty(0, bool)
    by_form = [*_forms(word_seg, n_segs, length, first_up, ups, number, mixed, begins, signs, np.where(leading, 1, np.where(marked, 0, 2))), chars, by_line]
    # A segment is rated in the language that most of its words are function words of.
    table = classes[found] if n_words else np.empty((0, len(LANGUAGES)), np.int8)
    is_function = known[:, None] & (table < CONTENT)
    in_seg = np.stack([np.bincount(word_seg[is_function[:, i]], minlength=n_segs) for i in range(len(LANGUAGES))], axis=1)
    function_share = np.stack([np.bincount(word_doc[is_function[:, i]], minlength=n_docs) for i in range(len(LANGUAGES))], axis=1)
    language = in_seg.argmax(axis=1)
    c = np.where(known, table[np.arange(n_words), language[word_seg]], CONTENT).astype(np.int64)
    c = np.where((c == CONTENT) & mixed, MIXED, np.where((c == CONTENT) & number, NUMBER, c))
    counts = np.bincount(word_seg * 10 + c, minlength=n_segs * 10).reshape(n_segs, 10)
    counts[:, SIGNS] = signs
    f, nxt = c < CONTENT, np.append(c[1:], CONTENT)
    broken = ((c == DET) & np.isin(nxt, (PREP, CONJ, PRON, AUX))) | ((c == PREP) & np.isin(nxt, (PREP, AUX)))
    pair = np.where(broken, 0, np.where(f & (nxt < CONTENT), 1, np.where(f, 2, np.where(nxt < CONTENT, 3, 4))))
    both = np.append(word_seg[1:] == word_seg[:-1], False)[:n_words]
    follow = np.bincount(word_seg[both] * 5 + pair[both], minlength=n_segs * 5).reshape(n_segs, 5)
    follow[follow.sum(axis=1) == 0, 4] = 1
    if not rate:
        return {}, by_form, [counts, follow, chars]
    targets = _targets()
    score = divergence(_shares(counts), targets[0]) + 3 * divergence(_shares(follow), targets[1]) + 0.5 * divergence(_shares(chars), targets[2]) + divergence(_shares(by_line), targets[3])
    of_language = np.array([[not x.startswith(("prose", "items", "short lines", "repeated")) or x.endswith(lang) for x in RATED] for lang in LANGUAGES])
    score[~of_language[language]] = np.inf
    profile = score.argmin(axis=1)
    # Segments with few function words of the known languages may be prose in another one.
    words_in_seg = np.bincount(word_seg, minlength=n_segs)
    strange = np.flatnonzero(~PROSE[profile] & (in_seg.max(axis=1) < FOREIGN_SHARE * words_in_seg))
    if strange.size:
        other, is_prose = _any_language()
        near = _nearest_is_prose([_shares(x[strange]) for x in by_form], other, is_prose, (1, 2, 4))
        profile[strange[near]] = OTHER_PROSE
    weight = chars[:, [0, 1, 3, 4]].sum(axis=1)
    total = np.bincount(seg_doc, weights=weight, minlength=n_docs)
    prose = np.bincount(seg_doc, weights=weight * PROSE[profile], minlength=n_docs)
    by_kind = np.zeros((n_docs, len(NAMES)))
    np.add.at(by_kind, (seg_doc, profile), weight)
    n_words_doc = np.bincount(word_doc, minlength=n_docs)
    lines_doc = np.bincount(line_doc[full], minlength=n_docs)
    letters = np.bincount(doc[k == 0], minlength=n_docs)
    word_letters = np.bincount(word_doc, weights=length, minlength=n_docs)
    visible_doc = np.bincount(doc[seen], minlength=n_docs)
    return {
        "n_chars": size, "n_words": n_words_doc, "n_lines": lines_doc, "word_length": word_letters / np.maximum(n_words_doc, 1),
        "symbol_ratio": np.bincount(doc[k == 4], minlength=n_docs) / np.maximum(visible_doc, 1), "digit_ratio": np.bincount(doc[k == 1], minlength=n_docs) / np.maximum(visible_doc, 1),
        "letter_ratio": letters / np.maximum(visible_doc, 1), "closed_lines": np.bincount(line_doc[closed], minlength=n_docs) / np.maximum(lines_doc, 1),
        "common_words": function_share.max(axis=1) / np.maximum(n_words_doc, 1), "repeated_lines": np.bincount(line_doc[again], minlength=n_docs) / np.maximum(lines_doc, 1),
        "prose_share": prose / np.maximum(total, 1), "profile": np.where(total > 0, by_kind.argmax(axis=1), -1),
        "repeated_chars": np.bincount(line_doc, weights=visible * again, minlength=n_docs) / np.maximum(visible_doc, 1),
    }, by_form, [counts, follow, chars]


FIGURES = {
    "n_chars": "bigint", "n_words": "bigint", "n_lines": "bigint", "word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "letter_ratio": "double",
    "closed_lines": "double", "common_words": "double", "repeated_lines": "double", "repeated_chars": "double", "prose_share": "double",
}


def statistics(df: DataFrame, key: str, text: str, *, window: int = 400) -> DataFrame:
    """id, the figures, profile (of most characters) and not_prose of each row."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{k} {t}" for k, t in FIGURES.items()) + ", profile string, not_prose boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Slices of about 4 M characters bound the work arrays.
            lo = 0
            sizes = np.diff(string_buffers(whole.column(1))[1]) if whole.num_rows else np.empty(0)
            cuts = np.cumsum(sizes) // 4_000_000
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo], side="right")))
                b = whole.slice(lo, hi - lo)
                m = measure(b.column(1), window)
                empty = m["profile"] < 0
                cols = [b.column(0)]
                for name, t in FIGURES.items():
                    cols.append(pa.array(m[name].astype(np.int64)) if t == "bigint" else pa.array(m[name], mask=empty))
                cols.append(pa.array([NAMES[p] if p >= 0 else "empty" for p in m["profile"]], pa.string()))
                cols.append(pa.array(~empty & (m["prose_share"] < 0.5)))
                yield pa.RecordBatch.from_arrays(cols, ["id", *FIGURES, "profile", "not_prose"])
                lo = hi

    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
