"""Surrogates for personal data and secrets.

Detected entities get keyed replacements of the same kind: e-mail addresses, phone and card numbers, IP
addresses, bank accounts, social security numbers, credentials, and names of people after a title. A
replacement keeps the format (digits stay digits, capitals stay capitals, prefixes such as country codes
stay), names keep gender and script. One entity has one replacement in the whole corpus, whatever its
spelling in a text, so references stay together; name parts are replaced one by one, so ``Mrs Ada Lane`` and
``Dr Lane`` stay the same person. A given name has one gender in the corpus, the least that its titles tell (f, m,
none). A secret is known by its value, whatever announces it.

Collisions are checked over the distinct entities of the corpus, of all kinds: where two would get the same
replacement, or one the original of another, all but the least entity draw again until none is left. Only entities
that drew again, or whose titles tell more than one gender, are handed to the texts, through a join on the hash of
the text; all others are computed in place.
Replacements get longer with the attempts, so that one is left however many values of a format occur.

Defined cases: a null text stays null, an empty one empty; texts without entities are unchanged; repeated rows
change alike; other columns are carried along.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.llm.words import text_slices
from gleaner.session import materialize

KEY = "replace this key in production"

#: titles and the gender they tell
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "г-жа"],
    "n": ["Dr", "Prof", "доктор"],
}
#: syllables and endings that names are made of, by script
SYLLABLES = {
    "latin": ["ba", "ber", "cor", "da", "den", "el", "fa", "gar", "hal", "jo", "ka", "lin", "lo", "mar", "mi", "nor", "or", "pe", "ra", "sel", "ta", "tor", "ul", "ven", "wil", "zo"],
    "cyrillic": ["ба", "вер", "гор", "да", "ди", "ек", "жа", "зо", "ил", "ка", "лен", "ма", "ми", "ник", "ол", "пет", "ра", "сер", "та", "фе", "юр", "яр"],
    "greek": ["αλ", "βα", "γε", "δη", "ελ", "θε", "ιω", "κα", "λε", "μα", "νι", "ξε", "πα", "ρο", "σο", "τη", "φι", "χα"],
}
ENDINGS = {
    "latin": {"m": ["us", "o", "an"], "f": ["a", "ia", "elle"], "n": ["in", "is"], "s": ["son", "mann", "ez", "ard"]},
    "cyrillic": {"m": ["ан", "ир", "ей"], "f": ["а", "ия", "ина"], "n": ["и", "о"], "s": ["ко", "енко", "ян"]},
    "greek": {"m": ["ος", "ης"], "f": ["α", "η"], "n": ["ι"], "s": ["ίδης", "άκης"]},
}

_ENDS = r"(?![\w])"
_NAME = r"(?![a-zß-öø-ÿά-ώа-я])[^\W\d_]+(?:['’-][^\W\d_]+)*"
_IS = r"""["']?[ \t]{0,8}[:=][ \t]{0,8}["']?"""
_IP4 = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"
_HEX4 = r"[0-9a-fA-F]{1,4}"
_GENDER = {spelt: g for g, ts in TITLES.items() for t in ts for spelt in (t, t.upper())}
_INITIALS = "".join(sorted({t[0] for t in _GENDER}))
_TITLE = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
#: prefixes of keys that services hand out; a replacement keeps them
_PREFIX = r"(?:gh[opsru]_|github_pat_|glpat-|sk-|pk-|xox[abprs]-|AIza)"
_PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+)
    |(?=[pP])(?:(?<![^\W_])(?i:password|passwd|pwd)|(?<=[a-z0-9])(?:Password|Passwd|Pwd)){_IS}(?P<password>[^\s"',;]+)
    |(?=[aAsStT])(?:(?<![^\W_])(?i:token|secret(?:[_-]?key)?|api[_-]?key|access[_-]?key)|(?<=[a-z0-9])(?:Token|Secret(?:Key)?|ApiKey|AccessKey)){_IS}(?P<token>[\w+/=.-]{{8,}})
    |-----BEGIN[ ](?:[A-Z]+[ ])?PRIVATE[ ]KEY-----(?P<block>.*?)(?:-----END|\Z)
    |(?=[bB])(?<![^\W_])(?i:bearer)[ ]+(?=[\w+/=.~-]*\d)(?P<bearer>[\w+/=.~-]{{16,}})
    |(?=[pP])(?<![^\W_])(?i:password|passphrase|passwd|pwd)[ ](?i:is|was)[ ]["']?(?=[^\s"',;\d]*\d)(?P<said>[^\s"',;]*[^\s"',;.!?])
    |(?=[Agpsx])(?<![\w-])(?P<service>{_PREFIX}(?=[\w-]*\d)[\w-]{{16,}})
    |(?<![\w])(?P<access>(?:AKIA|ASIA)[0-9A-Z]{{16}}){_ENDS}
    |(?<![\w])(?P<hex>(?=[a-fA-F]*[0-9])[0-9a-fA-F]{{32,}}){_ENDS}
    |(?<![\w.])(?P<ip>{_IP4})(?!\.?\w)
    |(?<![\w:.])(?=[a-fA-F:]*[0-9])(?P<ipv>(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{6}}{_IP4}
      |(?:{_HEX4}(?::{_HEX4}){{0,6}})?::(?:(?:{_HEX4}:){{0,5}}{_IP4}|{_HEX4}(?::{_HEX4}){{0,6}})?)(?![\w:]|\.\w)
    |(?<![\w])(?P<iban>[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?){_ENDS}
    |(?<![\w.-])(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?![\w-])
    |(?<![\w.-])(?P<card>\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}}|\d{{4}}[ -]\d{{6}}[ -]\d{{5}})(?![\w-])
    |(?P<phone>(?:(?<![\w+])\+\d{{1,3}}|(?<![\w+.-])00[1-9]\d{{0,2}})[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,4}}){{2,4}}{_ENDS}
      |(?<![\w.(-])\(\d{{3}}\)[ ]?\d{{3}}[ .-]\d{{4}}(?![\w-])
      |(?<![\w.-])\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?![\w-]|\.\w)
      |(?<![\w.-])1[ .-](?:\(\d{{3}}\)[ ]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?![\w-]|\.\w)
      |(?<![\w.-])0\d(?:[ .-]\d{{2}}){{4}}(?![\w-]|\.\w)
      |(?<![\w.-])0\d{{2,4}}[ ]\d{{3,4}}[ ]\d{{3,4}}(?![\w-]|\.\w))
    |(?=[{_INITIALS}])(?<![\w])(?P<title>{_TITLE})\.?[ ](?P<name>{_NAME}(?:[ ]{_NAME}){{0,3}})
    """,
    re.VERBOSE | re.DOTALL,
)
#: what every entity has: without any of these a text is left alone
_HINT = re.compile(rf"[0-9@:=]|-----BEGIN|(?=[{_INITIALS}])(?<![\w])(?:{_TITLE})\.?[ ]")
_CODE = re.compile(rf"[17]|{fixed.CALLING_CODES.removeprefix('^')}|\d{{1,3}}")
_SECRETS = {"password", "token", "block", "bearer", "said", "service"}
_DIGITS = {"card", "phone", "ssn", "ip"}
#: what values without letters and digits are drawn from; all may stand in a token or a password
_SYMBOLS = "+-./=_"


def _script(word: str) -> str:
    if any("Ѐ" <= c <= "ӿ" for c in word):
        return "cyrillic"
    return "greek" if any("Ͱ" <= c <= "Ͽ" for c in word) else "latin"


def _names(match: re.Match) -> list[tuple[int, int, str]]:
    """Spans and kinds of the parts of a name: capitalised words, the last one the family name."""
    at, parts = match.start("name"), []
    for word in match["name"].split(" "):
        if not word[:1].isupper():
            break
        parts.append((at, at + len(word)))
        at += len(word) + 1
    gender = _GENDER[match["title"]]
    return [(s, e, "surname" if i == len(parts) - 1 else f"given_{gender}") for i, (s, e) in enumerate(parts)]


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """Spans and kinds of the entities of a text, in order and without overlap."""
    if not _HINT.search(text):
        return []
    found, people = [], {}
    for match in _PATTERN.finditer(text):
        kind = match.lastgroup
        if kind == "name":
            for s, e, part in _names(match):
                found.append((s, e, part))
                if e - s > 1:
                    people.setdefault(text[s:e], part)
                    people.setdefault(text[s:e].upper(), part)
        else:
            found.append((match.start(kind), match.end(kind), kind))
    if people:  # the same name without its title
        taken = {s for s, _, _ in found}
        again = re.compile(rf"(?<![\w@.])(?:{'|'.join(sorted(map(re.escape, people), key=len, reverse=True))})(?![\w@])")
        spans = sorted((s, e) for s, e, _ in found)
        k = 0
        for match in again.finditer(text):
            while k < len(spans) and spans[k][1] <= match.start():
                k += 1
            if match.start() not in taken and (k == len(spans) or spans[k][0] >= match.end()):
                found.append((match.start(), match.end(), people[match.group()]))
    return sorted(found)


def entity(kind: str, original: str) -> tuple[str, str, str]:
    """What a span stands for: kind and value, the same for all its spellings, and the form a title tells."""
    if kind in _SECRETS:
        kind = "hex" if re.fullmatch(r"(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}", original) else "secret"
    name, _, form = kind.partition("_")
    return name, canonical(name, original), form


def canonical(kind: str, value: str) -> str:
    """One spelling for all spellings of an entity."""
    if kind == "ip":
        return value
    if kind == "ipv":
        try:
            return ipaddress.IPv6Address(value).compressed
        except ValueError:  # groups beyond eight
            return value.lower()
    if kind in _DIGITS:
        # the calling code after + or 00 stays apart from the number
        digits = re.sub(r"\D", "", value)
        if kind == "phone" and (value.startswith("+") or value.startswith("00")):
            digits = digits if value.startswith("+") else digits[2:]
            code = _CODE.match(digits)[0]
            return f"+{code}|{digits[len(code):]}"
        return digits
    if kind == "hex":
        return value.lower()
    if kind == "iban":
        return value.replace(" ", "")
    return value.casefold() if kind in ("email", "surname", "given") else value


def _stream(key: str, kind: str, value: str, attempt: int) -> Callable[[int], int]:
    """Numbers below a bound, drawn from a keyed hash."""
    state = {"pool": b"", "n": 0}
    base = f"{kind}\0{value}\0{attempt}\0".encode()

    def draw(bound: int) -> int:
        if len(state["pool"]) < 4:
            state["pool"] += hmac.new(key.encode(), base + str(state["n"]).encode(), hashlib.sha256).digest()
            state["n"] += 1
        number, state["pool"] = int.from_bytes(state["pool"][:4], "big"), state["pool"][4:]
        return number % bound

    return draw


def _shaped(value: str, draw: Callable[[int], int], lower: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Characters of the same class in every place; without letters and digits, other symbols."""
    if not any(c.isdigit() or c.isalpha() for c in value):
        return "".join(_SYMBOLS[draw(len(_SYMBOLS))] for _ in value)
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(draw(10)))
        elif c.isalpha():
            new = lower[draw(len(lower))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _longer(value: str, attempt: int) -> str:
    """The value with its last letter or digit repeated at the end, once for every second attempt."""
    last = next((c for c in reversed(value) if c.isdigit() or c.isalpha()), "*")
    return value + last * (attempt // 2)


def _luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def surrogate(kind: str, value: str, attempt: int, key: str, form: str = "n") -> str:
    """The replacement of a canonical entity, canonical as well."""
    draw = _stream(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        local = _longer(local, attempt)
        labels = domain.split(".")
        inner = _stream(key, "domain", domain, attempt // 4)  # a domain keeps its replacement as long as it can
        return f"{_shaped(local, draw)}@{'.'.join([*(_shaped(x, inner) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip":
        if attempt < 16:
            return ".".join(str(1 + draw(254)) for _ in range(4))
    if kind in ("ip", "ipv"):
        return ipaddress.IPv6Address(b"".join(draw(1 << 16).to_bytes(2, "big") for _ in range(8))).compressed
    valid = kind == "card" and _luhn(value) == 0
    if kind in ("phone", "ssn", "card", "iban", "access", "hex", "secret"):
        value = _longer(value, attempt)
    if kind == "card":
        body = value[0] + _shaped(value[1:-1], draw)
        if valid:
            return body + str((10 - _luhn(body + "0")) % 10)
        return body + str(draw(10))
    if kind in ("phone", "ssn"):
        code, _, rest = value.rpartition("|")
        digits = str(2 + draw(8)) + _shaped(rest[1:], draw)
        return f"{code}|{digits}" if code else digits
    if kind == "iban":
        return value[:2] + _shaped(value[2:], draw)
    if kind == "access":
        return value[:4] + _shaped(value[4:], draw)
    if kind == "hex" or (kind == "secret" and re.fullmatch(r"[0-9a-f]+", value)):
        return "".join("0123456789abcdef"[draw(16)] for _ in value)
    if kind == "secret":
        kept = re.match(_PREFIX, value)
        return value[: kept.end()] + _shaped(value[kept.end() :], draw) if kept else _shaped(value, draw)
    script = _script(value)
    end = ENDINGS[script]["s" if kind == "surname" else form]
    parts = SYLLABLES[script]
    return "".join(parts[draw(len(parts))] for _ in range(2 + draw(2) + attempt // 2)) + end[draw(len(end))]


def rendered(kind: str, original: str, new: str) -> str:
    """The replacement in the spelling of the original."""
    if kind in ("phone", "ssn", "card"):
        zeros = "00" if kind == "phone" and new.startswith("+") and not original.startswith("+") else ""
        digits = iter(zeros + new.replace("|", "").replace("+", ""))
        return "".join(next(digits) if c.isdigit() else c for c in original) + "".join(digits)
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in original) + "".join(rest)
    if kind == "hex":
        return new.upper() if original.isupper() else new
    if kind == "email" and len(new) == len(original):
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new))
    if kind in ("surname", "given"):
        return new.upper() if len(original) > 1 and original.isupper() else new[:1].upper() + new[1:]
    return new


def replace_entities(text: str, key: str = KEY, known: dict[tuple[str, str], tuple[int, str]] | None = None) -> tuple[str, list[str]]:
    """The text with its replacements, and the kinds replaced. ``known`` has (attempt, form) of entities that drew again
    or that have several forms in the corpus; of several forms in the text the least counts."""
    out, at, kinds = [], 0, []
    found = [(s, e, kind, *entity(kind, text[s:e])) for s, e, kind in find_entities(text)]
    forms: dict[tuple[str, str], str] = {}
    for *_, name, value, form in found:
        forms[name, value] = min(form, forms.get((name, value), form))
    for s, e, kind, name, value, _ in found:
        attempt, form = (known or {}).get((name, value), (0, forms[name, value]))
        new = surrogate(name, value, attempt, key, form)
        out += [text[at:s], rendered(name, text[s:e], new)]
        at = e
        kinds.append(kind.partition("_")[0])
    return "".join([*out, text[at:]]) if kinds else text, kinds


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = []
        for key, text in zip(batch.column("_text").to_pylist(), batch.column("text").to_pylist()):
            if text:
                rows += [(key, *x) for x in sorted({entity(k, text[s:e]) for s, e, k in find_entities(text)})]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_text", "kind", "value", "form"])


def _drawn(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "value", "form", "attempt"]
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in names))
            new = pa.array([surrogate(k, v, a, key, f) for k, v, f, a in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), new], names=[*names, "new"])

    return run


def _draw(values: DataFrame, key: str) -> DataFrame:
    return values.select("kind", "value", "form", "attempt").mapInArrow(_drawn(key), "kind string, value string, form string, attempt int, new string")


def redrawn(values: DataFrame, key: str = KEY) -> DataFrame:
    """Of the distinct ``kind, value, form`` of a corpus those that must draw again: ``kind, value, form, attempt``.

    First draws are written once; a round writes those that have drawn again, which are few.
    """
    first = materialize(_draw(values.withColumn("attempt", F.lit(0)), key), "surrogates")
    changed = None
    while True:
        drawn = first if changed is None else first.join(changed, ["kind", "value"], "anti").unionByName(changed)
        least = drawn.groupBy("new").agg(F.min(F.struct("kind", "value")).alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
        twice = drawn.join(least, "new").filter("struct(kind, value) <> _least").select("kind", "value")
        taken = drawn.join(first.select(F.col("value").alias("new")).distinct(), "new", "semi").select("kind", "value")
        again = materialize(twice.union(taken).distinct(), "again")
        if again.isEmpty():
            return drawn.filter("attempt > 0").select("kind", "value", "form", "attempt")
        retried = _draw(drawn.join(again, ["kind", "value"], "semi").withColumn("attempt", F.col("attempt") + 1), key)
        changed = materialize(retried if changed is None else changed.join(again, ["kind", "value"], "anti").unionByName(retried), "redrawn")


def _replace(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts, kinds = [], []
            for text, again in zip(batch.column("text").to_pylist(), batch.column("_again").to_pylist()):
                known = {(x["kind"], x["value"]): (x["attempt"], x["form"]) for x in again or []}
                new, found = replace_entities(text, key, known) if text else (text, [])
                texts.append(new)
                kinds.append(found)
            out = {"text": pa.array(texts, batch.schema.field("text").type), "_kinds": pa.array(kinds, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict({n: out.get(n, batch.column(n)) for n in batch.schema.names if n != "_again"} | {"_kinds": out["_kinds"]})

    return run


def _surrogated(docs: DataFrame, key: str) -> DataFrame:
    """``docs``, which has no column named as those added here, with new texts and ``_kinds``."""
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    entities = materialize(keyed.select("_text", "text").mapInArrow(_find, "_text long, kind string, value string, form string"), "entities")
    values = materialize(entities.groupBy("kind", "value").agg(F.min("form").alias("form"), F.max("form").alias("_last")), "values")
    again = redrawn(values.select("kind", "value", "form"), key)
    several = values.filter("form <> _last").select("kind", "value", "form", F.lit(0).alias("attempt"))
    told = again.unionByName(several.join(again, ["kind", "value"], "anti"))
    by_text = materialize(
        entities.select("_text", "kind", "value").join(told, ["kind", "value"]).distinct()
        .groupBy("_text").agg(F.collect_list(F.struct("kind", "value", "attempt", "form")).alias("_again")),
        "redrawn",
    )
    joined = keyed.join(by_text, "_text", "left").select(*docs.columns, "_again")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_replace(key), f"{schema}, _kinds array<string>")


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; same columns."""
    own = {c: c if c == "text" else f"_own_{i}" for i, c in enumerate(docs.columns)}
    replaced = _surrogated(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), key)
    return replaced.select(*[F.col(n).alias(c) for c, n in own.items()])


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id, text, n_entities, kinds``: one row per document with its new text."""
    return _surrogated(docs.select("doc_id", "text"), key).select(
        "doc_id", "text", F.size("_kinds").cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("_kinds")), ",").alias("kinds"),
    )
