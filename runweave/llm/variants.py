"""Variant spellings of names: canonical rewritings joined by equality.

Every name of the register is rewritten by the rules below (short first names, initials, legal and other short
forms, prefixes, order of the parts, sound, one slip) and each rewriting is a row. A name as typed has its own form,
its sound, and the forms with one letter left out; one equi-join of all these finds the register names it can stand for. Two forms that meet without a letter
are checked exactly afterwards, so that one letter more, less or other and two exchanged neighbours pass and nothing else does.

Short first names come by rule (the first three letters or more of a name, and these with y, ie or i and a doubled last letter), from a table that is a
parameter, and from the data: where names agree in all words but one, and a word unknown to the register stands for the same
word of it in ``support`` names or more and in most of the names where it stands for any, it is a rewriting of that word.

Score: log2(1 + names / names that give this form) / (1 + cost of the rule), so that rare and cheap rewritings count more; register names and typed
names are counted alike. The best score decides; a name that then still stands for several register names is left open.

Only distinct names are rewritten, so a name in a third of all rows costs no more than a rare
one. The register may be large: it is never collected, and its forms are joined by shuffle.

Edge cases: null and empty names give no rows; a name without letters or digits has no form; names of any length and number of words are
rewritten; forms over ``whole`` letters meet for slips by their halves, of which one slip spoils one only; forms of four and five letters bear a slip
only behind an equal first letter, shorter ones none; short first names by rule bear none, as they are many; numbers must agree; repeated register rows count once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.names import VERSION_WORDS, within
from runweave.llm.plainform import plain_column
from runweave.session import cut

# Short forms of first names.
NICKNAMES = {
    "alexander": "alex al sandy sasha xander lex", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny benji", "christopher": "chris kit topher",
    "daniel": "dan danny", "deborah": "deb debbie debby", "edward": "ed eddie ted ned eddy", "elizabeth": "liz lizzie beth betty eliza lisa betsy", "frederick": "fred freddy freddie rick",
    "gabriella": "gabby gabi ella gaby", "gregory": "greg", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "jonathan": "jon jonny johnny nathan", "josephine": "jo josie jojo",
    "katherine": "kate kathy katie kat kathie kitty", "lawrence": "larry laurie lars", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge", "matthew": "matt matty", "michael": "mike mick mickey mikey",
    "nicholas": "nick nicky nico", "patricia": "pat patty trish tricia", "philippa": "pippa pip", "rebecca": "becca becky bec", "richard": "rich rick dick ricky richie", "robert": "rob bob bobby robbie bert",
    "samuel": "sam sammy", "stephanie": "steph steffi stevie", "susannah": "sue susie suzy susan", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy",
    "valentina": "val tina", "victoria": "vicky tori vic vicki vickie", "william": "will bill billy willy liam", "zachary": "zach zack zac", "david": "dave davo davy", "joseph": "joe joey", "charles": "charlie chuck chaz",
    "alexandra": "alex sandra lexi", "caroline": "caro carrie", "catherine": "cath cathy kate", "dorothy": "dot dottie", "eleanor": "nell ellie nora", "francis": "frank frankie", "george": "geo georgie", "henry": "harry hank",
    "john": "jack johnny", "kenneth": "ken kenny", "peter": "pete", "ronald": "ron ronnie", "stephen": "steve", "walter": "walt wally", "vincent": "vince vinny", "isabella": "bella izzy", "jessica": "jess jessie",
    "kimberly": "kim", "pamela": "pam", "sandra": "sandy", "teresa": "terry tess", "abigail": "abby gail", "amanda": "mandy", "barbara": "barb babs", "christina": "tina chris chrissy", "cynthia": "cindy",
}
# Short forms of the words that say what kind of act it is.
FORMS = {
    "orchestra": "orch orchestre orc", "quartet": "qtet qrt quart 4tet qt", "company": "co comp cmpy cpy", "department": "dept dep dpt", "project": "proj prj", "brothers": "bros bro", "collective": "coll col collect",
    "ensemble": "ens ensbl", "club": "clb", "radio": "rad", "trio": "tr", "assembly": "assy assem", "incorporated": "inc", "limited": "ltd", "association": "assoc assn", "society": "soc", "band": "bnd", "system": "sys", "sound": "snd", "experience": "exp",
}
PREFIXES = ("dj", "mc")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)
FIRST = frozenset(NICKNAMES) | {n for v in NICKNAMES.values() for n in v.split()}
# Spellings of one sound, applied in this order.
SOUNDS = (("ck", "k"), ("qu", "kw"), ("ph", "f"), ("c", "k"), ("q", "k"), ("x", "ks"), ("ee", "i"), ("ie", "i"), ("ea", "i"), ("y", "i"), ("oo", "u"), ("ou", "u"), ("z", "s"))


def tokens(text: str) -> list[str]:
    """Words in lower case; an apostrophe parts none."""
    return _WORD.findall(text.casefold().replace("'", "").replace("’", ""))


# Letters without a decomposition, and two-letter spellings.
BARE = str.maketrans({"ø": "o", "æ": "ae", "ł": "l", "đ": "d", "ß": "ss", "œ": "oe", "ı": "i"})
TWO_LETTERS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe"})


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.translate(BARE)) if not unicodedata.combining(c))


def sound(key: str) -> str:
    for a, b in SOUNDS:
        key = key.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", key)


def short_names(given: str) -> set[str]:
    """Short forms of a first name by rule: its first letters, at least three, and short ones with an ending."""
    out = {given[:k] for k in range(3, len(given))}
    for stem in {given[:3], given[:4]} & out:
        double = stem if stem[-1] == stem[-2] or stem[-1] in "aeiouy" else stem + stem[-1]
        out |= {x + end for x in (stem, double) for end in ("y", "ie", "i")}
    return out - {given}


def rewritings(name: str, nicknames: dict[str, str] = NICKNAMES, forms: dict[str, str] = FORMS) -> list[tuple[str, str, str, int]]:
    """(form, first word, rule, cost) of one register name, the cheapest rule of each form."""
    words = tokens(name)
    if not words:
        return []
    out: dict[str, tuple[str, str, int]] = {}

    def put(parts: list[str], rule: str, cost: int, turned: bool = False) -> None:
        key = "".join(parts)
        if key and (key not in out or out[key][2] > cost):
            out[key] = (parts[-1] if turned else parts[0], rule, cost)

    bodies = [(words, "", 0)]
    middle = re.sub(r'\s"[^"]*"\s', " ", name)
    if middle != name:
        bodies.append((tokens(middle), "middle", 1))
    prefixed = words[0] in PREFIXES and len(words) > 1
    article = words[0] == "the" and len(words) > 1
    if prefixed or article:
        rest, what = words[1:], "prefix" if prefixed else "article"
        put(rest + words[:1], "order", 1, True)
        bodies.append((rest, what, 1))
    for body, what, cost in list(bodies):
        # Short legal forms, with and without the article.
        for i, w in enumerate(body):
            for short in forms.get(w, "").split():
                bodies.append((body[:i] + [short] + body[i + 1 :], "legal form", cost + 1))
    for body, what, cost in bodies:
        put(body, what or "as it is", cost)
        if article and what == "legal form" and body[0] == "the":
            put(body[1:] + body[:1], "order", cost + 1, True)
    # Accents left out, and two letters for one as in German and Danish.
    for bare in {unaccented(" ".join(words)), unaccented(" ".join(words).translate(TWO_LETTERS))} - {" ".join(words)}:
        put(bare.split(), "accents", 1)
    if "and" in words:
        put([w for w in words if w != "and"], "ampersand", 1)
    person = len(words) > 1 and not (prefixed or article) and not any(w.isdigit() for w in words) and words[-1] not in forms
    if person:
        given, rest = words[0], words[1:]
        put(rest + [given], "order", 1, True)
        put(words[-1:] + words[:-1], "order", 1, True)
        put([given[0]] + rest, "initial", 3)
        put(rest + [given[0]], "initial", 3, True)
        if len(rest) > 1:
            initials = [w[0] for w in words[:-1]]
            put(initials + rest[-1:], "initial", 3)
            put(rest[-1:] + initials, "initial", 3, True)
            put([given, *initials[1:], rest[-1]], "initial", 3)
        if middle != name and len(rest) == 2:
            put([given[0], rest[1]], "initial", 4)
            put([rest[1], given], "order", 2, True)
        for nick in nicknames.get(given, "").split():
            put([nick] + rest, "nickname", 2)
            put(rest + [nick], "nickname", 3, True)
        for nick in short_names(given):
            put([nick] + rest, "nickname", 4)
        for p in PREFIXES:
            put([p] + words, "prefix", 2)
    return [(k, f, r, c) for k, (f, r, c) in out.items()]


def credit(title: Column) -> Column:
    """Who made the version: the last brackets without the words that say what it is."""
    words = "|".join(sorted(VERSION_WORDS))
    inside = F.regexp_extract(title, r"[(\[（［]([^()\[\]（）［］]*)[)\]）］]\s*[^\p{L}\p{N}]*$", 1)
    named = F.regexp_extract(inside, rf"(?iU)^\s*(.+?)(?:\s+(?:{words}))+\s*$", 1)
    by = F.regexp_extract(inside, r"(?iU)\bby\s+(.+)$", 1)
    return F.nullif(F.when(by != "", by).otherwise(named), F.lit(""))


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name -> name, form, first, last, sound, words of the typed names."""
    for b in batches:
        col = b.column(0)
        words = [tokens(x) for x in plain_column(col)[0].to_pylist()]
        keys = ["".join(w) for w in words]
        ends = [[w[k] if w else "" for w in words] for k in (0, -1)]
        texts = [pa.array(x, pa.string()) for x in (keys, *ends, map(sound, keys))]
        yield pa.RecordBatch.from_arrays([col, *texts, pa.array(words, pa.list_(pa.string()))], ["name", "form", "first", "last", "heard", "words"])


def _forms(nicknames: dict[str, str], forms: dict[str, str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, first, rule, cost, sound(k)) for i, n in zip(f["id"], f["name"]) for k, first, rule, cost in rewritings(n, nicknames, forms)]
            yield pd.DataFrame(rows, columns=["id", "form", "first", "rule", "cost", "heard"])

    return run


def _shorter(key: Column) -> Column:
    """The key and the key without each one of its letters."""
    return F.array_distinct(F.concat(F.array(key), F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))))


def _halves(key: Column) -> Column:
    """Beginnings and ends of about half the length, for lengths that differ by one; of two keys with one slip between them one half is the same."""
    n = F.length(key)
    one = lambda m: F.array(F.concat(F.lit("<"), m.cast("string"), F.lit("<"), F.substring(key, F.lit(1), F.floor(m / 2).cast("int"))), F.concat(F.lit(">"), m.cast("string"), F.lit(">"), F.right(key, (m - F.floor(m / 2) - 1).cast("int"))))
    return F.array_distinct(F.flatten(F.array(one(n - 1), one(n), one(n + 1))))


def _slips(key: Column, whole: int) -> Column:
    return F.when(F.length(key) < 4, F.array().cast("array<string>")).when(F.length(key) <= whole, _shorter(key)).otherwise(_halves(key))


def _checked(kind: pd.Series, typed: pd.Series, form: pd.Series, first: pd.Series, last: pd.Series, head: pd.Series) -> pd.Series:
    out = []
    for k, t, f, a, z, h in zip(kind, typed, form, first, last, head):
        if k != SLIP:
            out.append(t == f)
            continue
        digits = re.sub(r"\D", "", t) == re.sub(r"\D", "", f)
        # A slip makes no other first name or initial of one.
        apart = h not in (a, z) and ((len(h) == 1) or any(x in FIRST or len(x) == 1 or x in PREFIXES for x in (a, z)))
        short = len(f) < 6 and t[:1] != f[:1]
        out.append(bool(digits and not apart and not short and within(t, f, 1)))
    return pd.Series(out, dtype=bool)


FORM, SOUND, SLIP = 0, 1, 2


def _holes(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """around, word: words of names of several words, with the others around their place. known: words that are passed over."""
    each = df.where(F.size("words") > 1).select("words", F.posexplode("words").alias("at", "word"))
    if known is not None:
        each = each.where("length(word) > 1").join(known, "word", "left_anti")
    around = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("at")), F.lit("\x01"), F.slice("words", F.col("at") + 2, F.size("words")))
    return each.select(around.alias("around"), "word").distinct()


def learned_words(typed: DataFrame, known: DataFrame, support: int = 3, most: float = 0.6, shared: int = 3) -> DataFrame:
    """written, word: words that the register does not have and that stand for one of its words. typed, known: words (of each distinct name).

    Surroundings that more than ``shared`` register names have say nothing about a single word and are passed over."""
    of = _holes(known)
    telling = of.groupBy("around").agg(F.collect_set("word").alias("to"), F.count(F.lit(1)).alias("n")).where(F.col("n") <= shared)
    vocabulary = known.select(F.explode("words").alias("word")).distinct()
    new = _holes(typed, vocabulary).withColumnRenamed("word", "written")
    pairs = new.join(telling, "around").select("around", "written", F.explode("to").alias("word"))
    each = pairs.groupBy("written", "word").agg(F.countDistinct("around").alias("n"))
    total = pairs.groupBy("written").agg(F.countDistinct("around").alias("all"))
    return each.where(F.col("n") >= support).join(total, "written").where(F.col("n") >= most * F.col("all")).select("written", "word")


def _near(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the rows were counted and are few, else joined by sorting; the optimizer's own estimate is no bound here."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


#: Counted tables of short rows (under 200 bytes) up to this many rows are broadcast.
BROADCAST_ROWS = 50_000


def resolve(typed: DataFrame, register: DataFrame, *, whole: int = 60, support: int = 3, nicknames: dict[str, str] = NICKNAMES, short_forms: dict[str, str] = FORMS) -> DataFrame:
    """typed: name. register: id, name. Gives name, id, rule, score for each distinct typed name that stands for one register name and is written otherwise."""
    id_type = register.schema["id"].dataType.simpleString()
    known = register.where("id IS NOT NULL AND name IS NOT NULL").select("id", "name").distinct()
    names = cut(
        typed.where("name IS NOT NULL AND name <> ''").select("name").distinct()
        .mapInArrow(_plain, "name string, form string, first string, last string, heard string, words array<string>").where("form <> ''")
    )
    own = known.select("name").distinct().mapInArrow(_plain, "name string, form string, first string, last string, heard string, words array<string>").where("form <> ''")
    words = cut(known.join(own.select("name", "form", "words"), "name").select("id", "form", "words"))
    n_known = words.count()
    # Names as the register has them are no variants.
    new = cut(names.join(_near(words.select("form").distinct(), n_known), "form", "left_anti"))
    written = cut(learned_words(new.select("words"), words.select("words").distinct(), support))
    placed = words.select("id", "words", F.posexplode("words").alias("at", "word"))
    replaced = placed.join(_near(written, written.count()), "word").select("id", F.transform("words", lambda w, k: F.when(k == F.col("at"), F.col("written")).otherwise(w)).alias("w"))
    sounded = F.pandas_udf(lambda s: s.map(sound), "string")
    taught = replaced.select("id", F.array_join("w", "").alias("form"), F.element_at("w", 1).alias("first"), F.lit("learned").alias("rule"), F.lit(2).alias("cost")).withColumn("heard", sounded("form"))
    made = known.mapInPandas(_forms(nicknames, short_forms), f"id {id_type}, form string, first string, rule string, cost int, heard string")
    # A form that several rules of one name give counts by its cheapest.
    forms = cut(made.unionByName(taught).groupBy("id", "form", "heard").agg(F.min(F.struct("cost", "rule", "first")).alias("m")).select("id", "form", "heard", "m.first", "m.rule", "m.cost"))
    # How many names give a form, those of the register and typed ones.
    given = forms.select("form", "id", F.lit(None).cast("string").alias("name")).unionByName(names.select("form", F.lit(None).cast(id_type).alias("id"), "name"))
    rarity = given.groupBy("form").agg((F.countDistinct("id") + F.countDistinct("name")).alias("n"))
    total = float(names.count() + n_known)
    score = F.log2(1 + total / F.col("n")) / (1 + F.col("cost"))
    counted = forms.join(rarity.hint("merge"), "form")
    # The three ways in which forms meet, each a row: as they are, by sound, without a letter.
    row = lambda kind, text, keys, extra: F.struct(F.lit(kind).alias("kind"), text.alias("text"), keys.alias("keys"), F.lit(extra).alias("extra"))
    form, heard = F.col("form"), F.col("heard")
    none = F.array().cast("array<string>")
    ways = lambda by_ear, slips: F.explode(F.array(row(FORM, form, F.array(form), 0), row(SOUND, heard, F.when(by_ear, F.array(heard)).otherwise(none), 2), row(SLIP, form, F.when(slips, _slips(form, whole)).otherwise(none), 4)))
    keyed = lambda df, by_ear, slips, *cols: df.select(*cols, ways(by_ear, slips).alias("w")).select(*cols, "w.kind", "w.text", "w.extra", F.explode("w.keys").alias("k")).withColumn("k", F.xxhash64("kind", "k"))
    long = F.length("form") >= 6
    left = keyed(new, long, F.lit(True), "name", "first", "last").select("name", F.col("first").alias("a"), "last", "kind", F.col("text").alias("t"), "k")
    right = keyed(counted, long & (F.col("cost") <= 1), F.col("cost") < 4, "id", "first", "rule", "cost", "n").select("id", F.col("first").alias("h"), "kind", F.col("text").alias("f"), F.col("cost") + F.col("extra"), F.when(F.col("kind") == SOUND, "sound").when(F.col("kind") == SLIP, "slip").otherwise(F.col("rule")).alias("rule"), "n", "k").toDF("id", "h", "kind", "f", "cost", "rule", "n", "k")
    met = left.join(right.hint("merge"), ["kind", "k"]).select("name", "id", "kind", "t", "f", "a", "last", "h", "rule", score.alias("score")).distinct()
    check = F.pandas_udf(_checked, "boolean")
    best = cut(met.where(check("kind", "t", "f", "a", "last", "h")).groupBy("name", "id").agg(F.max(F.struct("score", "rule")).alias("b")))
    # The best score of a name decides, if it leads to one register name. Two names with equal scores are a list
    # of as many rows as register names share the form, so no window is needed.
    top = best.groupBy("name").agg(F.max("b.score").alias("top"))
    ranked = best.join(top, "name").where("b.score = top").groupBy("name").agg(F.count(F.lit(1)).alias("m"), F.first("id").alias("id"), F.first("b").alias("b"))
    return ranked.where("m = 1").select("name", "id", F.col("b.rule").alias("rule"), F.col("b.score").alias("score"))
