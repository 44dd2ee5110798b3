"""Keyed surrogates for personal data.

Detected entities (e-mail, telephone, payment card, bank account (IBAN), social
security number, IPv4 and IPv6 address, access key, hexadecimal token, titled
person name) are replaced by values of the same type and format: digits for
digits, letters for letters, the same separators, valid check digits, names of
the same gender and script. A script without a list of names here gets letters of
its own. A telephone number of ten digits is one entity with and without its +1;
others keep their country code. A surrogate is drawn from an HMAC of the
entity's canonical value, so one entity gets one surrogate in all documents
(coreference). A name is found by its title; within that text its capitalised
repeats are the same entity, with or without title, given name or full capitals.

Distinctness is checked over the whole corpus: where two entities draw one
surrogate, or a surrogate is some entity's real value, the entity with the
least canonical value keeps it and the others draw again, round by round,
until none clash. Only distinct entities take part, never texts.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, located, scratch, written

KEY = b"surrogate-key-1"
EMAIL = re.compile(r"(?<![\w.+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![\w-])")
PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])")
ABROAD = re.compile(r"(?<![\w.+])\+[1-9]\d{0,2}[ ./-]?\(?\d{1,5}\)?(?:[ ./-]?\d{2,5}){1,5}(?![\w-])")
NATIONAL = re.compile(r"(?<![\w./+-])0\d{2,4}/\d{5,8}(?![\w/-])")
SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])(?!\.\d)")
#: Country calling codes of one and two digits; all others have three.
SHORT_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                  "81 82 84 86 90 91 92 93 94 95 98".split())
CARD = re.compile(r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])")
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w])(?!\.\d)")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])")
#: Titles by gender.
TITLES = {"mr": "m", "herr": "m", "monsieur": "m", "sr": "m", "señor": "m", "г-н": "m", "господин": "m",
          "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "mme": "f", "madame": "f", "sra": "f", "señora": "f",
          "г-жа": "f", "госпожа": "f", "κ": "m", "κύριος": "m", "κα": "f", "κυρία": "f"}
NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
                  + r")(\.?[ ])([^\W\d_]+(?:-[^\W\d_]+)?)(?:([ ])([^\W\d_]+(?:-[^\W\d_]+)?))?", re.IGNORECASE)
#: A word that may repeat a surname, without a title.
WORD = re.compile(r"(?<![\w@])[^\W\d_]+(?:-[^\W\d_]+)*(?![\w@])")
GIVEN = {
    ("latin", "m"): "adam bruno carl david erik felix georg hugo ivan jonas kurt leon marco nils oscar paul ralf simon "
                    "thomas victor".split(),
    ("latin", "f"): "anna bella clara diana emma frida greta hanna irene julia karla lena maria nora olga paula rosa "
                    "sofia teresa vera".split(),
    ("cyrillic", "m"): "андрей борис виктор глеб денис егор иван кирилл максим олег".split(),
    ("cyrillic", "f"): "анна вера галина дарья елена ирина ксения мария ольга софья".split(),
    ("greek", "m"): "αλέξης γιάννης δημήτρης ηλίας κώστας μάρκος νίκος πέτρος σταύρος στέφανος".split(),
    ("greek", "f"): "άννα βάσω δήμητρα ειρήνη ελένη ζωή κατερίνα μαρία όλγα σοφία".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ge ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so "
                      "ta te to va ve vo".split(),
             "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но па по ра ре ро са "
                         "се со та те то".split(),
             "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε "
                      "το".split()}
#: How surnames of a script end, and what the form of one gender adds to the form both share.
SURNAME_END = {"cyrillic": "в", "greek": "δάκη"}
ENDINGS = {("cyrillic", "f"): "а", ("greek", "m"): "ς"}
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    """Check digits of an IBAN, so that the whole leaves 1 when divided by 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


@functools.cache
def _script_of_letter(c: str) -> str:
    name = unicodedata.name(c, "LATIN").split()[0].split("-")[0].lower()
    return "latin" if name in ("fullwidth", "feminine", "masculine", "modifier") else name


def script_of(word: str) -> str:
    """The script of the first letter, as Unicode names it."""
    return next((_script_of_letter(c) for c in word if c.isalpha()), "latin")


@functools.cache
def letters_of(script: str) -> str:
    """Letters of a script without a list of names (small ones where it has cases)."""
    if script == "cjk":
        return "".join(map(chr, range(0x4E00, 0x9FA0)))
    if script == "hangul":
        return "".join(map(chr, range(0xAC00, 0xD7A4)))
    found = "".join(c for c in map(chr, range(0x250, 0x3100)) if unicodedata.category(c) in ("Ll", "Lo")
                    and _script_of_letter(c) == script)
    return found or LOWER


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


class Stream:
    """Numbers drawn from an HMAC of the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed, self.n, self.have = (key, f"{kind}\x00{value}\x00{attempt}".encode()), 0, b""

    def below(self, n: int) -> int:
        if len(self.have) < 4:
            key, text = self.seed
            self.have = hmac.new(key, text + b"\x00%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.have = int.from_bytes(self.have[:4], "big"), self.have[4:]
        return x % n

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case; all else stays."""
        return "".join(DIGIT[self.below(10)] if c in DIGIT else LOWER[self.below(26)] if c.islower()
                       else UPPER[self.below(26)] if c.isupper() else c for c in text)


def draw(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate of a canonical value. From attempt 24 on, it may be longer, so that a free one exists."""
    s = Stream(key, kind, value, attempt)
    longer = max(0, attempt - 23)
    if kind == "email":
        local, _, domain = value.partition("@")
        name, _, end = domain.rpartition(".")
        return s.like(local) + "".join(LOWER[s.below(26)] for _ in range(longer)) + "@" + s.like(name) + "." + end
    if kind == "phone" and value[0] == "+":
        code = country_code(value[1:])
        body = value[1 + len(code):]
        return "+" + code + ("0" if body[0] == "0" else DIGIT[1 + s.below(9)]) + s.like(body[1:] + "0" * longer)
    if kind == "phone":  # a fictional exchange (555) stays
        area = "23456789"[s.below(8)] + s.like("00")
        exchange = value[3:6] if value[3:6] == "555" else "23456789"[s.below(8)] + s.like("00")
        return area + exchange + s.like("0000") + s.like("0" * longer)
    if kind == "national":
        return "0" + DIGIT[1 + s.below(9)] + s.like(value[2:] + "0" * longer)
    if kind == "ssn":
        area = 1 + s.below(898)
        return f"{area + (area >= 666):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}" + s.like("0" * longer)
    if kind == "iban":
        account = s.like(value[4:] + "0" * longer)
        return value[:2] + iban_digits(value[:2], account) + account
    if kind == "ipv6":  # local networks stay local, groups of zeros stay
        own = ipaddress.IPv6Address(value).exploded.split(":")
        hexa = DIGIT + "abcdef"
        new = [g if int(g, 16) == 0 else "".join(hexa[(i == 0) + s.below(15)] for i in range(len(g.lstrip("0")))) for g in own]
        new[0] = own[0] if own[0][:2] in ("fc", "fd", "fe", "ff") else own[0] if own[0] == "0000" else "2" + new[0][:3].zfill(3)
        for i in range(min(longer, 7)):
            new[7 - i] = "".join(hexa[1 + s.below(15)] for _ in range(4))
        return ipaddress.IPv6Address(":".join(new)).compressed
    if kind == "card":
        body = value[0] + s.like("0" * (len(value) - 2 + longer))
        return body + luhn_digit(body)
    if kind == "ipv4":
        own = value.split(".")
        keep = 1 if own[0] in ("10", "127") else 2 if own[:2] in (["192", "168"],) else 0
        return ".".join(own[:keep] + [str(1 + s.below(254)) for _ in own[keep:]]) + "".join(
            f".{s.below(255)}" for _ in range(longer))
    if kind == "secret":
        return value[:4] + "".join((UPPER + DIGIT)[s.below(36)] for _ in range(len(value) - 4 + longer))
    if kind == "token":
        digits = "0123456789abcdef" if value.islower() or value.isdigit() else "0123456789ABCDEF"
        return "".join(digits[s.below(16)] for _ in range(len(value) + longer))
    what, script, gender = kind.split(":")
    if script not in SYLLABLES:
        own = letters_of(script)
        return "".join(own[s.below(len(own))] for _ in range(max(2, len(value)) + attempt // 8))
    if what == "given":
        names = GIVEN[script, gender]
        if attempt == 0:
            return names[s.below(len(names))]
        tail = SYLLABLES[script]  # more names than the list holds: a second part
        return names[s.below(len(names))] + "-" + tail[s.below(len(tail))] + tail[s.below(len(tail))] + (
            "" if attempt < 8 else tail[s.below(len(tail))])
    tail = SYLLABLES[script]
    name = "".join(tail[s.below(len(tail))] for _ in range(3 + attempt // 8))
    return name + (SURNAME_END[script] if script in SURNAME_END else "nrstl"[s.below(5)])


def _surname_base(word: str, script: str, gender: str) -> str:
    """The form of a surname that both genders share: Cyrillic -ова, -ева, -ина without -а, Greek -ης, -ας without -ς."""
    low = word.lower()
    if script == "greek":
        return low[:-1] if low.endswith(("ης", "ής", "ας", "άς")) else low
    return low[:-1] if script == "cyrillic" and gender == "f" and low.endswith(("ова", "ева", "ина")) else low


def _name_parts(m: re.Match) -> list[tuple[str, str, str, tuple[int, int]]]:
    """(kind, canonical, ending, span) of the given name and surname after a title."""
    gender = TITLES[m[1].lower()]
    out = []
    words = [(m[3], m.span(3))] if m[5] is None or not m[5][0].isupper() else [(m[3], m.span(3)), (m[5], m.span(5))]
    if m[3][0].islower():  # scripts without cases have neither
        return []
    if len(words) == 2:
        script = script_of(words[0][0])
        out.append((f"given:{script}:{gender}", words[0][0].lower(), "", words[0][1]))
    word, span = words[-1]
    script = script_of(word)
    # the surname is one entity for both genders; its ending follows the title
    out.append((f"surname:{script}:m", _surname_base(word, script, gender), ENDINGS.get((script, gender), ""), span))
    return out


def _repeats(text: str, titled) -> list[tuple[int, int, str, str, str]]:
    """Capitalised repeats, without a title, of the names that stand in this text with one."""
    forms, bases = {}, {}
    for kind, value, ending, (start, end) in sorted(titled, key=lambda p: p[0].startswith("given")):  # surnames first
        forms.setdefault(text[start:end].lower(), (kind, value, ending))
        if kind.startswith("surname"):
            bases.setdefault(value, kind)
    if not forms:
        return []
    own = {span for *_, span in titled}
    out = []
    for m in WORD.finditer(text):
        word = m[0].lower()
        if m.span() in own or m[0][0].islower() or len(word) < 2 or word in TITLES:
            continue
        script = script_of(word)
        base = _surname_base(word, script, "f")
        if word in forms:
            out.append((*m.span(), *forms[word]))
        elif word in bases:  # the form that adds nothing, of a name that stands here in the other gender's
            out.append((*m.span(), bases[word], word, ""))
        elif base in bases:
            out.append((*m.span(), bases[base], base, word[len(base):]))
    return out


def _valid_ip(text: str) -> bool:
    return all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in text.split("."))


def _phone(text: str) -> str:
    """Ten digits for a number of the +1 plan with or without +1; else + and all digits."""
    digits = re.sub(r"\D", "", text)
    ten = len(digits) == 10 and "+" not in text or len(digits) == 11 and digits[0] == "1"
    return digits[-10:] if ten else "+" + digits


def _ipv6(text: str) -> str | None:
    """The short form of an address of a host; None for anything else with colons."""
    if sum(map(bool, text.split(":"))) < 3 or not any(c in DIGIT for c in text):
        return None
    try:
        return ipaddress.IPv6Address(text).compressed
    except ValueError:
        return None


def _iban(text: str) -> str | None:
    value = text.replace(" ", "")
    return value if 15 <= len(value) <= 34 and iban_digits(value[:2], value[4:]) == value[2:4] else None


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """Entities from left to right without overlap: (start, end, kind, canonical value, ending)."""
    out = []
    if "@" in text:
        out += [(*m.span(), "email", m[0].lower(), "") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "card", d, "") for m in CARD.finditer(text)
            if luhn_digit((d := re.sub(r"\D", "", m[0]))[:-1]) == d[-1]]
    out += [(*m.span(), "phone", _phone(m[0]), "") for m in PHONE.finditer(text)]
    if "+" in text:
        out += [(*m.span(), "phone", _phone(m[0]), "") for m in ABROAD.finditer(text)
                if 8 <= sum(c in DIGIT for c in m[0]) <= 15]
    if "/" in text:
        out += [(*m.span(), "national", m[0].replace("/", ""), "") for m in NATIONAL.finditer(text)]
    out += [(*m.span(), "ssn", m[0].replace("-", ""), "") for m in SSN.finditer(text)]
    out += [(*m.span(), "iban", v, "") for m in IBAN.finditer(text) if (v := _iban(m[0]))]
    if text.count(":") > 1:
        out += [(*m.span(), "ipv6", v, "") for m in IPV6.finditer(text) if (v := _ipv6(m[0]))]
    out += [(*m.span(), "ipv4", m[0], "") for m in IPV4.finditer(text) if _valid_ip(m[0])]
    if "AKIA" in text or "ASIA" in text:
        out += [(*m.span(), "secret", m[0], "") for m in SECRET.finditer(text)]
    out += [(*m.span(), "token", m[0], "") for m in TOKEN.finditer(text)]
    titled = [part for m in NAME.finditer(text) for part in _name_parts(m)]
    out += [(*span, kind, value, ending) for kind, value, ending, span in titled]
    out += _repeats(text, titled)
    clean, last = [], 0
    for e in sorted(out, key=lambda e: (e[0], -e[1])):
        if e[0] >= last:
            clean.append(e)
            last = e[1]
    return clean


def shaped(original: str, kind: str, surrogate: str, ending: str = "") -> str:
    """The canonical surrogate in the format of this occurrence: its separators and capitals."""
    if kind in ("phone", "national", "card", "ssn", "iban"):
        own = sum(map(str.isalnum, original))
        # of a ten-digit entity with its country code, the code stays
        keep = own - 10 if kind == "phone" and surrogate[0] != "+" else 0
        left = iter(surrogate.lstrip("+"))
        out = []
        for c in original:
            if c.isalnum() and keep > 0:
                keep -= 1
                out.append(c)
            else:
                out.append(next(left) if c.isalnum() else c)
        return "".join([*out, *left])
    if kind == "ipv6":
        if "::" not in original:
            full = ipaddress.IPv6Address(surrogate).exploded
            surrogate = full if all(len(g) == 4 for g in original.split(":")) else ":".join(
                g.lstrip("0") or "0" for g in full.split(":"))
        return surrogate.upper() if original != original.lower() else surrogate
    if kind in ("ipv4", "secret", "token"):
        return surrogate
    surrogate += ending
    if original.isupper() and len(original) > 1:
        return surrogate.upper()
    if kind == "email":
        same = len(original) == len(surrogate)
        return "".join(c.upper() if o.isupper() else c for o, c in zip(original, surrogate)) if same else surrogate
    return "-".join(p[:1].upper() + p[1:] for p in surrogate.split("-")) if original[:1].isupper() else surrogate


def replace(text: str, hits: list[tuple[int, int, str, str, str]]) -> tuple[str, dict[str, int]]:
    """The text with its entities (start, end, kind, surrogate, ending) replaced, and how many there were of each kind."""
    out, at, kinds = [], 0, {}
    for start, end, kind, surrogate, ending in sorted(hits):
        out += [text[at:start], shaped(text[start:end], kind, surrogate, ending)]
        at = end
        kinds[kind.split(":")[0]] = kinds.get(kind.split(":")[0], 0) + 1
    return "".join([*out, text[at:]]), kinds


SPANS = "array<struct<start:int,until:int,ending:string>>"


def _detect(batches):
    """Texts -> one row per row and distinct entity in it, with the places where it stands."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("until", pa.int32()), ("ending", pa.string())]))
    for batch in batches:
        at, kinds, values, spans = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            places: dict[tuple[str, str], list] = {}
            for start, end, kind, value, ending in find(text or ""):
                places.setdefault((kind, value), []).append({"start": start, "until": end, "ending": ending})
            for (kind, value), where in places.items():
                at.append(i)
                kinds.append(kind)
                values.append(value)
                spans.append(where)
        picked = batch.select(["_file", "_row"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(kinds, pa.string()), pa.array(values, pa.string()),
                                          pa.array(spans, spans_type)], ["_file", "_row", "kind", "value", "spans"])


def _draw(key: bytes, attempt: int):
    def run(batches):
        for batch in batches:
            made = [draw(key, k, v, attempt) for k, v in zip(batch.column("kind").to_pylist(),
                                                            batch.column("value").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             [*batch.schema.names, "surrogate"])
    return run


def assign(entities: DataFrame, key: bytes = KEY, max_rounds: int = 60) -> DataFrame:
    """Distinct (kind, value) -> (kind, value, surrogate): no surrogate twice, none equal to a real value."""
    spark = entities.sparkSession
    real = entities.select("kind", F.col("value").alias("surrogate"))
    pending, done, used = entities, None, []
    for attempt in range(max_rounds):
        drawn = pending.mapInArrow(_draw(key, attempt), "kind string, value string, surrogate string")
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        won = written(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select(
            "kind", "value", "surrogate"), scratch(spark, "surrogates"))
        done = won if done is None else done.unionByName(won)
        path = scratch(spark, "pending")
        pending = written(pending.join(won, ["kind", "value"], "left_anti"), path)
        if pending.isEmpty():
            discard(spark, path, *used)
            return done
        used.append(path)
    raise RuntimeError("entities without a surrogate are left")


def _rewrite(batches):
    for batch in batches:
        texts, counts, kinds = [], [], []
        for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist()):
            if text is None:
                texts.append(None)
                counts.append(0)
                kinds.append([])
                continue
            new, per = replace(text, [(p["start"], p["until"], k["kind"], k["surrogate"], p["ending"])
                                      for k in known or () for p in k["spans"]])
            texts.append(new)
            counts.append(sum(per.values()))
            kinds.append([{"kind": k, "n": n} for k, n in sorted(per.items())])
        names = [n for n in batch.schema.names if n not in ("text", "known")]
        per_kind = pa.list_(pa.struct([("kind", pa.string()), ("n", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
             pa.array(kinds, per_kind)], [*names, "text", "n_entities", "kinds"])


def pseudonymise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_entities, kinds (kind, n).

    Null text stays null, an empty text empty; an empty table gives an empty one.
    Repeated rows get the same result. A text is held whole, with its entities, by
    one task at a time. Other columns are not read. The same key gives the same
    surrogates on the same corpus.
    """
    spark = docs.sparkSession
    src = located(docs, id_col, text_col).toDF("doc_id", "text", "_file", "_row")
    seen = written(src.select("_file", "_row", "text").mapInArrow(
        _detect, f"_file string, _row long, kind string, value string, spans {SPANS}"), scratch(spark, "entities"))
    path = scratch(spark, "distinct-entities")
    mapping = assign(written(seen.select("kind", "value").distinct(), path), key)
    discard(spark, path)
    known = seen.join(mapping, ["kind", "value"]).groupBy("_file", "_row").agg(
        F.collect_list(F.struct("kind", "surrogate", "spans")).alias("known"))  # the entities of one text
    return src.join(known, ["_file", "_row"], "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "known").mapInArrow(
        _rewrite, "doc_id long, text string, n_entities long, kinds array<struct<kind:string,n:long>>")
