"""PII surrogates (DataFrame functions only).

One pattern finds e-mail addresses, network addresses, card, phone and social security numbers, bank accounts, access
keys, secrets after a key word, and names after an honorific or a phrase that introduces one. Every entity gets a
surrogate that depends on the caller's key and on its canonical form (case, spacing and separators don't matter), so the
same entity has the same surrogate in all documents. It keeps the type and the format: digits, letters, cases and
separators stay in place, card numbers keep a valid check digit (or an invalid one), network addresses go to the
reserved block 240/4, social security numbers to the unissued 9xx, e-mail domains below .example, names keep honorific,
script and capitals.

Names are replaced word by word. A word that is a given name anywhere in the corpus is one everywhere, and its gender is
the one that most of its honorifics give, so "Dr. Ada Lind", "Ms. Ada" and "Ms. Lind" agree with each other. Words of a
name that was found in a document are replaced in the rest of that document too, where they stand alone.

Distinctness: for most kinds the surrogate is a keyed permutation of the format's space (a Feistel network over the
characters, each shifted within its class), so no two entities can share one. Reserved blocks are smaller than what they
stand for and names are made of syllables: these are hashed, compared, and hashed again while they collide. Surrogates
that are another entity of the corpus are tried again too. Only entities that collide go through another round; after
MAX_ATTEMPTS rounds (the block is full) a social security number or address gets a permutation of the space outside the
block, and a permuted entity whose format has no free value left keeps its first surrogate, so the end is always a
one-to-one mapping. Entities whose surrogate isn't their first one, and names whose form the corpus decides, meet the
documents in a join by text hash (128 bits) that Spark may broadcast if it is small and that shuffles otherwise.

Texts without a digit, an "@", an honorific, a key word, an introduction or an access key's prefix are passed by.
Cases: a null text stays null, with 0 entities; null ids, repeated rows and extra columns, whatever their names, are
kept as they are; very long texts and entities are handled whole and in linear time, in one pass of possessive patterns;
an empty table gives an empty table; an empty key raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, stored, unpacked

#: The key of the registered queries where KEY_SETTING is unset: for tests and trials; surrogates under it are not secret.
KEY_SETTING, TRIAL_KEY = "spark.trajlens.pii.key", "trial key, not secret"
MAX_ATTEMPTS, MAX_PERMUTED, ROUNDS = 64, 4, 4
#: Honorifics by the gender that the names after them have.
HONORIFICS = {"m": "Mr|Sir|Herr|Herrn|Monsieur|Señor|Sr|Don|г-н|Господин", "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|г-жа|Госпожа", "n": "Dr|Prof|Доктор"}
_ANY = "|".join(HONORIFICS.values())
#: Phrases that introduce a name of two or three words.
INTRODUCTIONS = "name is|Name ist|heiße|heisse|llamo|nombre es|appelle|зовут"
_WORD = r"\p{Lu}[\p{L}'’-]++"
_TITLED = rf"(?=[A-ZГДг])(?<![\p{{L}}])(?:(?:{_ANY})\.? ){{1,3}}{_WORD}(?: {_WORD}){{0,2}}"
NAME = rf"(?:{_TITLED}|(?=\p{{Lu}})(?<=(?:{INTRODUCTIONS}) ){_WORD}(?: {_WORD}){{1,2}})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[0-9.-]*+[A-Za-z])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
PHONE = r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
ACCESS_KEY = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?:ghp|gho|sk|pk|xoxb|xoxp)[_-][0-9A-Za-z_-]{16,}+)(?![0-9A-Za-z])"
SECRET = r"""(?<=["']|[=:][ ]{0,2})(?<=(?i:password|passwd|pwd|token|secret|api_key|apikey)["']?[ ]{0,2}[=:][ ]{0,2}["']?)[A-Za-z0-9+/_.-]{8,}+"""
#: In the order in which they are tried at a place.
KINDS = {"name": NAME, "secret": SECRET, "email": EMAIL, "access_key": ACCESS_KEY, "iban": IBAN, "ip": IP, "ssn": SSN, "card": CARD, "phone": PHONE}
ENTITY = "|".join(KINDS.values())
#: Texts that fail all of these hold no entity: cheap scans before the pattern.
HAS_DIGIT, HAS_SIGN = "[0-9@]", "[=:]"
HAS_ACCESS_KEY = "(?:AKIA|(?:ghp|gho|sk|pk|xoxb|xoxp)[_-])[0-9A-Za-z_-]{16}"
HAS_KEY_WORD = "(?i)(?:password|passwd|pwd|token|secret|api_?key)"
HAS_NAME = rf"(?=[A-ZГДг])(?<![\p{{L}}])(?:{_ANY})\.? \p{{Lu}}"
HAS_INTRODUCTION = rf"(?:{INTRODUCTIONS}) \p{{Lu}}"
#: Parts from which names are made, by script, and how given names end, by script and gender.
SYLLABLES = {"latin": "ba be bo da de do fa fi ga go ha he jo ka ke ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi wa we ya zo".split(), "cyrillic": "ба бо ва ве во га го да де до за зо ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се со та те ти то".split()}
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "l"}, "cyrillic": {"m": "н", "f": "на", "n": "л"}}
SURNAME_END = {"latin": "rd", "cyrillic": "рк"}


#: Kinds whose surrogates are permutations.
PERMUTED = ("email", "access_key", "phone", "card", "secret", "iban")


def session_key(spark: SparkSession, default: str | None = None) -> str:
    """The session's key, from KEY_SETTING; where it is unset, the default that a caller names, else an error: nobody gets surrogates that aren't secret without asking."""
    key = spark.conf.get(KEY_SETTING, None) or default
    if not key:
        raise ValueError(f"set {KEY_SETTING}, or name a default")
    return key


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digest(key: str, *parts: str) -> str:
    """64 bytes as hex."""
    return f"sha2(concat_ws('|', {_quoted(key)}, {', '.join(parts)}), 512)"


def _byte(digest: str, i: str) -> str:
    return f"cast(conv(substr({digest}, (({i}) % 64) * 2 + 1, 2), 16, 10) as int)"


def _shifted(c: str, v: str, hexadecimal: bool) -> str:
    """A character moved by v within its class; others stay."""
    if hexadecimal:
        return f"substr('0123456789abcdef', (instr('0123456789abcdef', {c}) - 1 + {v}) % 16 + 1, 1)"
    cases = [("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)]
    return "case " + " ".join(f"when {c} between '{lo}' and '{hi}' then char(ascii('{lo}') + (ascii({c}) - ascii('{lo}') + {v}) % {n})" for lo, hi, n in cases) + f" else {c} end"


def _permuted(key: str, x: str, tweak: str, hexadecimal: bool = False) -> str:
    """A keyed permutation of the strings of x's shape: halves take turns at shifting each other's characters."""
    moved = f"array_join(transform(split(st.a, ''), (c, j) -> {_shifted('c', _byte('d', 'j'), hexadecimal)}), '')"
    turn = f"named_struct('a', st.b, 'b', if(st.a = '', '', {_let(_digest(key, tweak, 'r', 'st.b'), 'd', moved)}))"
    start = "named_struct('a', substr(x0, 1, cast(char_length(x0) / 2 as int)), 'b', substr(x0, cast(char_length(x0) / 2 as int) + 1))"
    numbers = f"array({', '.join(_quoted(str(i)) for i in range(ROUNDS))})"
    return _let(x, "x0", f"aggregate({numbers}, {start}, (st, r) -> {turn}, st -> concat(st.a, st.b))")


def _outside(key: str, x: str, tweak: str, block: str, hexadecimal: bool) -> str:
    """A permutation of the values that don't begin with block: the whole space's one, again until it is outside."""
    step = lambda y: _permuted(key, y, tweak, hexadecimal)
    return f"aggregate(sequence(1, 32), {step(x)}, (w, n) -> if(startswith(w, '{block}'), {step('w')}, w))"


def _in_block(key: str, x: str, kind: str, attempt: str, block: str, hexadecimal: bool) -> str:
    """x's surrogate in the reserved block; values that lie in it are permuted there and never need another attempt."""
    own = f"concat('{block}', {_permuted(key, f'substr({x}, 2)', _quoted(kind), hexadecimal)})"
    d = _digest(key, _quoted(kind), f"cast({attempt} as string)", x)
    drawn = f"substr({d}, 1, char_length({x}) - 1)" if hexadecimal else f"array_join(transform(sequence(1, char_length({x}) - 1), i -> cast({_byte('d', 'i - 1')} % 10 as string)), '')"
    drawn = f"concat('{block}', {drawn if hexadecimal else _let(d, 'd', drawn)})"
    return f"case when startswith({x}, '{block}') then {own} when {attempt} < {MAX_ATTEMPTS} then {drawn} else {_outside(key, x, _quoted(kind), block, hexadecimal)} end"


def _check_digit(body: str) -> str:
    """The Luhn digit of a card number's other digits: from the right every second digit is doubled."""
    return f"(10 - aggregate(transform(split(reverse({body}), ''), (c, j) -> if(j % 2 = 0, 2 * cast(c as int) - if(2 * cast(c as int) > 9, 9, 0), cast(c as int))), 0, (s, x) -> s + x) % 10) % 10"


def _syllables(script: str, digest: str, n: str) -> str:
    parts = SYLLABLES[script]
    listed = ", ".join(_quoted(p) for p in parts)
    return f"array_join(transform(sequence(0, {n} - 1), i -> element_at(array({listed}), {_byte(digest, '2 * i')} % {len(parts)} + 1)), '')"


def kind_of(raw: Column) -> Column:
    found = F.lit("secret")
    named = rf"^(?:{_TITLED}|{_WORD}(?: {_WORD}){{1,2}})$"  # after an introduction there are at least two words
    for kind in reversed([k for k in KINDS if k != "secret"]):
        found = F.when(raw.rlike(named if kind == "name" else f"^(?:{KINDS[kind]})$"), kind).otherwise(found)
    return found


def surrogate_of(kind: str, canon: str, attempt: str, form: str, key: str = TRIAL_KEY) -> str:
    """SQL for the surrogate of a canonical entity, itself canonical; the arguments are SQL expressions. form: of names."""
    t = lambda name: f"concat('{name}', cast({attempt} as string))"
    local, domain = f"substring_index({canon}, '@', 1)", f"substring_index({canon}, '@', -1)"
    email = f"concat({_permuted(key, local, f'concat({domain}, cast({attempt} as string))')}, '@', {_permuted(key, domain, _quoted('domain'))}, '.example')"
    ip = f"array_join(transform(split({canon}, '[.]'), o -> lpad(lower(hex(cast(o as int))), 2, '0')), '')"
    ip = _let(_let(ip, "y", _in_block(key, "y", "ip", attempt, "f", True)), "h", "concat_ws('.', transform(array(1, 3, 5, 7), k -> conv(substr(h, k, 2), 16, 10)))")
    body = f"substr({canon}, 1, char_length({canon}) - 1)"
    moved = f"concat(substr({canon}, 1, 1), {_permuted(key, f'substr({canon}, 2, char_length({canon}) - 2)', t('card'))})"
    card = _let(moved, "b", f"concat(b, cast(({_check_digit('b')} + 10 + cast(right({canon}, 1) as int) - {_check_digit(body)}) % 10 as string))")
    iban = f"concat(substr({canon}, 1, 2), if({attempt} < {MAX_ATTEMPTS}, '00', substr({canon}, 3, 2)), {_permuted(key, f'substr({canon}, 5)', t('iban'))})"
    prefix = "'^(AKIA|[a-z]+[_-])'"
    access = f"concat(regexp_extract({canon}, {prefix}, 1), {_permuted(key, f"regexp_replace({canon}, {prefix}, '')", t('access'))})"
    secret = f"if({canon} rlike '^[0-9a-f]+$', {_permuted(key, canon, t('hex'), True)}, {_permuted(key, canon, t('secret'))})"
    cases = [("email", email), ("ip", ip), ("ssn", _in_block(key, canon, "ssn", attempt, "9", False)), ("card", card), ("phone", _permuted(key, canon, t("phone"))), ("iban", iban), ("access_key", access), ("secret", secret)]
    d = _digest(key, "'name'", canon, f"cast({attempt} as string)")
    more = f"2 * least({attempt}, 8)"
    forms = [(f"{script}_surname", script, 4, SURNAME_END[script]) for script in SYLLABLES] + [(f"{script}_given_{g}", script, 3, end) for script in SYLLABLES for g, end in ENDINGS[script].items()]
    name = _let(d, "d", "case " + " ".join(f"when {form} = '{f}' then concat({_syllables(script, 'd', f'({n} + {more})')}, '{end}')" for f, script, n, end in forms) + " end")
    return "case " + " ".join(f"when {kind} = '{k}' then {sql}" for k, sql in [*cases, ("name", name)]) + " end"


def _maybe(t: Column) -> Column:
    return F.coalesce(t.rlike(HAS_DIGIT) | t.rlike(HAS_NAME) | (t.rlike(HAS_SIGN) & t.rlike(HAS_KEY_WORD)) | t.rlike(HAS_ACCESS_KEY) | t.rlike(HAS_INTRODUCTION), F.lit(False))


def found_in(text: Column) -> Column:
    """The entities of a text in order; null where the cheap scans find nothing."""
    return F.when(_maybe(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


_PREFIX = rf"^(?:(?:{_ANY})\.? )+"


def parts_of(raw: Column) -> Column:
    """The parts of an entity that are replaced on their own: array of (kind, canon, form); form is empty but for names."""
    kind = kind_of(raw)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    canon = (
        F.when(kind == "email", F.lower(raw))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind == "iban", F.upper(F.regexp_replace(raw, " ", "")))
        .otherwise(raw)
    )
    title = F.regexp_extract(raw, _PREFIX, 0)
    gender = F.when(title.rlike(rf"(?:^| )(?:{HONORIFICS['m']})\b"), "m").when(title.rlike(rf"(?:^| )(?:{HONORIFICS['f']})\b"), "f").otherwise("n")
    words = F.split(F.regexp_replace(raw, _PREFIX, ""), " ")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    form = lambda w, i: F.concat(script(w), F.when(i == F.size(words) - 1, "_surname").otherwise(F.concat(F.lit("_given_"), gender)))
    names = F.transform(words, lambda w, i: F.struct(F.lit("name").alias("kind"), F.lower(w).alias("canon"), form(w, i).alias("form")))
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.lit("").alias("form"))))


def entities(docs: DataFrame) -> DataFrame:
    """kind, canon, form, said, n: the distinct entities of all texts, each with every form it is said in and how often.

    form is what the corpus decides: a name's word is given if it is given anywhere, with the gender most often said.
    """
    raw = docs.select(F.explode(found_in(F.col("text").cast("string"))).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    said = raw.select(F.explode(parts_of(F.col("raw"))).alias("p"), "n").groupBy("p.kind", "p.canon", F.col("p.form").alias("said")).agg(F.sum("n").alias("n"))
    by = Window.partitionBy("kind", "canon")
    given, count = F.col("said").contains("_given_"), lambda g: F.coalesce(F.sum(F.when(F.col("said").endswith(f"_given_{g}"), F.col("n"))).over(by), F.lit(0))
    gender = F.when(count("f") + count("m") == 0, "n").when(count("f") >= count("m"), "f").otherwise("m")
    script = F.substring_index("said", "_", 1)
    form = F.when(F.max(given).over(by), F.concat(script, F.lit("_given_"), gender)).otherwise(F.col("said"))
    return said.select("kind", "canon", form.alias("form"), "said", "n")


def _clashing(tried: DataFrame, taken: DataFrame) -> DataFrame:
    """tried(kind, canon, form, surrogate, attempt) with clash: the surrogate is taken or an earlier row has it."""
    in_block = (F.col("kind").isin("ip") & F.col("canon").rlike("^2(4[0-9]|5[0-5])")) | (F.col("kind").isin("ssn") & F.col("canon").startswith("9"))
    turn = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy((~in_block).cast("int"), "canon"))
    return tried.withColumn("turn", turn).join(taken.select("kind", "surrogate", F.lit(True).alias("is_taken")).distinct(), ["kind", "surrogate"], "left").select("kind", "canon", "form", "surrogate", "attempt", ((F.col("turn") > 1) | F.coalesce("is_taken", F.lit(False))).alias("clash"))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, form, attempt, surrogate for found(kind, canon, form): one to one, and not in found where that can be."""

    def tried(rows: DataFrame, attempt: int) -> DataFrame:
        rows = rows.withColumn("attempt", F.lit(attempt))
        return rows.select("kind", "canon", "form", F.expr(surrogate_of("kind", "canon", "attempt", "form", key)).alias("surrogate"), "attempt")

    real = found.select("kind", F.col("canon").alias("surrogate"))
    first = stored(_clashing(tried(found, 0), real))
    done, waiting = [first.where("not clash")], first.where("clash")
    for attempt in range(1, MAX_ATTEMPTS + 1):
        if not waiting.take(1):
            break
        if attempt == MAX_ATTEMPTS:
            done.append(tried(waiting, attempt).withColumn("clash", F.lit(False)))
            break
        if attempt == MAX_PERMUTED:  # nothing of their format is free: the first one is nobody else's
            stay = waiting.where(F.col("kind").isin(*PERMUTED) & (F.col("kind") != "iban")).select("kind", "canon")
            done.append(first.join(stay, ["kind", "canon"], "left_semi").select(*first.columns))
            waiting = waiting.join(stay, ["kind", "canon"], "left_anti")
        taken = real.unionByName(first.select("kind", "surrogate"))
        for d in done[1:]:
            taken = taken.unionByName(d.select("kind", "surrogate"))
        now = stored(_clashing(tried(waiting, attempt), taken))
        done.append(now.where("not clash"))
        waiting = now.where("clash")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("kind", "canon", "form", "attempt", "surrogate")


def _spliced(raw: Column, parts: Column) -> Column:
    """The text to put in place of raw, given its parts' surrogates (array of kind, s)."""
    kind, s = parts[0]["kind"], parts[0]["s"]
    digits = F.regexp_replace(raw, "[^0-9]", "")
    full = F.concat(F.substring(digits, F.lit(1), F.char_length(digits) - F.char_length(s)), s)  # a country code stays
    place = lambda i: F.char_length(F.regexp_replace(F.substring(raw, F.lit(1), i), "[^0-9]", ""))
    chars = F.transform(F.sequence(F.lit(1), F.char_length(raw)), lambda i: F.when(F.substring(raw, i, F.lit(1)).rlike("[0-9]"), F.substring(full, place(i), F.lit(1))).otherwise(F.substring(raw, i, F.lit(1))))
    spaced = F.transform(F.sequence(F.lit(1), F.char_length(raw)), lambda i: F.when(F.substring(raw, i, F.lit(1)) == " ", " ").otherwise(F.substring(s, i - F.char_length(F.regexp_replace(F.substring(raw, F.lit(1), i), "[^ ]", "")), F.lit(1))))
    named = F.concat(F.regexp_extract(raw, _PREFIX, 0), F.array_join(F.transform(_words(raw), lambda w, i: _cased(w, parts[i]["s"])), " "))
    return F.when(kind.isin("phone", "card", "ssn"), F.array_join(chars, "")).when(kind == "iban", F.array_join(spaced, "")).when(kind == "name", named).otherwise(s)


def _words(raw: Column) -> Column:
    return F.split(F.regexp_replace(raw, _PREFIX, ""), " ")


def _cased(word: Column, s: Column) -> Column:
    return F.when(F.upper(word) == word, F.upper(s)).otherwise(F.initcap(s))


#: What runs of letters in which names are looked for are made of.
_RUN = r"[\p{L}'’-]"


def _bucketed(entries: str) -> Column:
    """Entries "word NUL surrogate" dealt to as many buckets as the root of their number by a hash of the word, so that neither dealing nor looking up takes their square."""
    named = f"transform({entries}, x -> named_struct('h', hash(substring_index(x, '\\0', 1)), 'w', substring_index(x, '\\0', 1), 's', substring_index(x, '\\0', -1)))"
    of = _let(named, "xs", "transform(sequence(0, cast(ceil(sqrt(size(xs))) as int) - 1), b -> filter(xs, x -> pmod(x.h, cast(ceil(sqrt(size(xs))) as int)) = b))")
    return F.expr(f"if(size({entries}) > 0, {of}, array())")


def _renamed(t: Column) -> Column:
    """A run of letters with its name replaced: it is one of the names, or one with something after its last or first apostrophe."""
    found = lambda w: F.filter(F.get("names", F.pmod(F.hash(w), F.size("names"))), lambda x: x["w"] == w)
    tries = F.array(t, F.regexp_replace(t, "'[^']*$", ""), F.substring_index(t, "'", 1))
    hits = F.filter(F.transform(tries, lambda w: F.struct(w.alias("w"), F.get(found(w), F.lit(0))["s"].alias("s"))), lambda x: x["s"].isNotNull())
    first = F.get(hits, F.lit(0))
    return F.when(F.size(hits) > 0, F.concat(first["s"], F.substring(t, F.char_length(first["w"]) + 1, F.char_length(t)))).otherwise(t)


def replace_entities(docs: DataFrame, key: str, kinds_col: str | None = None) -> DataFrame:
    """docs with text replaced by its surrogates' text; kinds_col adds the kind of each entity replaced, in order."""
    if not key:
        raise ValueError("surrogates need a key")
    said = stored(entities(docs))
    found = surrogates(stored(said.select("kind", "canon", "form").distinct()), key)
    again = stored(said.select("kind", "canon", "said").join(found, ["kind", "canon"]).where("attempt > 0 or form <> said").select("kind", "canon", "said", "form", "attempt"))
    df = packed(docs, F.col("text").cast("string").alias("text"))
    df = df.withColumn("raw", found_in(F.col("text"))).withColumn("parts", F.transform("raw", parts_of))
    label = lambda k, f, c: f"concat_ws(':', {k}, {f}, {c})"
    if again.take(1):
        df = df.withColumn("t", F.when(F.col("raw").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("2"), "text").alias("b"))))
        keyed = df.where("raw is not null").select("t", F.explode(F.flatten("parts")).alias("p")).select("t", "p.kind", "p.canon", F.col("p.form").alias("said")).distinct()
        entry = F.struct(F.expr(label("kind", "said", "canon")), F.struct("attempt", "form"))
        tries = keyed.join(again, ["kind", "canon", "said"]).groupBy("t").agg(F.map_from_entries(F.collect_list(entry)).alias("tries"))
        df = df.join(tries, "t", "left")
    else:
        df = df.withColumn("tries", F.lit(None).cast("map<string,struct<attempt:int,form:string>>"))
    other = f"element_at(tries, {label('p.kind', 'p.form', 'p.canon')})"
    surrogate = surrogate_of("p.kind", "p.canon", "o.attempt", "o.form", key)
    one = _let(f"coalesce({other}, named_struct('attempt', 0, 'form', p.form))", "o", f"named_struct('kind', p.kind, 's', {surrogate})")
    df = df.withColumn("done", F.expr(f"transform(parts, q -> transform(q, p -> {one}))")).drop("parts", "tries")
    new = F.zip_with("raw", "done", _spliced)
    # the words of names, for where they stand alone: as strings, whose distinct ones are found by hashing
    entry = lambda w, s: F.concat(w, F.lit("\x00"), s)
    each = F.flatten(F.zip_with("raw", "done", lambda r, q: F.when(q[0]["kind"] == "name", F.zip_with(_words(r), q, lambda w, p: entry(w, _cased(w, p["s"])))).otherwise(F.expr("cast(array() as array<string>)"))))
    df = df.withColumn("new", new).withColumn("names", F.array_distinct(F.concat(each, F.transform(each, F.upper))))
    df = df.withColumn("names", _bucketed("names"))
    between = F.split("text", ENTITY, -1)
    alone = lambda seg: F.array_join(F.transform(F.regexp_extract_all(seg, F.lit(rf"{_RUN}+|[^{_RUN[1:]}+"), F.lit(0)), lambda t: F.when(t.rlike(r"^\p{Lu}"), _renamed(t)).otherwise(t)), "")
    between = F.when(F.size("names") > 0, F.transform(between, alone)).otherwise(between)
    whole = F.array_join(F.zip_with(between, "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("raw") > 0, whole).otherwise(F.col("text"))
    kinds = F.coalesce(F.transform("done", lambda q: q[0]["kind"]), F.expr("cast(array() as array<string>)"))
    return unpacked(df, docs, {"text": text}, {kinds_col: kinds} if kinds_col else {})
