"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clvforge.llm.common import cut, id_and_text, join_lookup

#: Forms of address before a name, by gender; academic titles tell none.
TITLES = {
    "m": ["mr", "mister", "herr", "herrn", "señor", "sr", "monsieur", "sir", "господин", "κύριος"],
    "f": ["mrs", "ms", "miss", "mme", "mlle", "madame", "mademoiselle", "frau", "señora", "sra", "madam", "госпожа", "κυρία"],
    "n": ["dr", "doctor", "prof", "professor", "docteur", "professeur", "доктор", "профессор"],
}
#: What surrogate names are made of, by script: beginnings and vowels of syllables, ends of family
#: names (two lists that are combined), ends of given names by gender.
SYLLABLES = {
    "latin": ("b d f g h j k l m n p r s t v w br dr fl gr kl kr pl pr sl st tr th sch fr".split(), "a e i o u ai ei au".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split()),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο ου".split()),
}
FAMILY_ENDS = {
    "latin": ("l n r s m ck ld lm nd ng nt rd rk rt st".split(),
              "a o er en el ez in is et eau ini ard man son sen ley well ton ford berg feld stein hardt wood worth mann hoff bach dale more ".split()
              + "ova ak ik uk as es os ard ier oux".split()),
    "cyrillic": ("л н р с м в д т".split(), "енко ич ук юк як ак ий ан ар ец".split()),
    "greek": ("λ ν ρ σ μ τ".split(), "ου ίδης άκης όπουλος ιάδης άτος έας".split()),
}
GIVEN_ENDS = {
    ("latin", "m"): "no bert rd rik mas ton lf mund drew vin gor lian".split(), ("latin", "f"): "na la ra lia nia ria ssa line tta lde lena mia".split(),
    ("latin", "n"): "ny ly ri mi ney ley sy dy".split(),
    ("cyrillic", "m"): "н р слав мир лан дей тий рий".split(), ("cyrillic", "f"): "на ла ра лия ния ша та ма".split(), ("cyrillic", "n"): "ни ли ри".split(),
    ("greek", "m"): "νος λης ρης μος τος".split(), ("greek", "f"): "να λη ρα μία τη".split(), ("greek", "n"): "νι λι ρι".split(),
}
#: Small words inside family names.
PARTICLES = frozenset("van von der den de del della di da du des dos das la le el al bin ibn ter ten zu zum af av y e".split())
#: Words that end a name, though a capital begins them (headings, sentence starts).
_NOT_NAMES = frozenset("a an and as at but by der die das du el er es for from goes had has he her his i ihr in is it la las le les los "
                       "mr mrs ms my not of on or our she sie the their they this to und was we who will with you your says said met to".split())
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}


def _one_of(words: list[str]) -> str:
    """A regular expression for the words that branches letter by letter, so that most places fail at their first."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [c + _one_of(rest) if c else "" for c, rest in sorted(heads.items(), reverse=True)]  # longer words first
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


#: Titles as written: small, with a capital, in capitals. Spelled out, since engines fold case differently.
_TITLE = _one_of(sorted({f for t in _GENDER for f in (t, t.capitalize(), t.upper())}))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_WORD_NAME = r"[^\W\d_][\w'’-]*"
_STREET_WORD = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Ct Square Terrace Crescent".split()
_STREET_TAIL = "straße strasse str weg platz allee gasse".split()
_STREET_HEAD = "rue avenue boulevard place chemin impasse Calle Avenida Plaza Paseo Camino".split()
_BORN = ("[Bb]orn(?: on)?|DOB|D\\.O\\.B\\.|[Dd]ate of [Bb]irth|[Gg]eboren(?: am)?|[Nn]ée? le|[Nn]acid[oa] el|[Ff]echa de nacimiento")
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_H = "[0-9A-Fa-f]{1,4}"
#: Version 6 addresses with two groups and a digit at least, so that '[::2]' and 'Face::Add' are none.
_V6 = (r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)(?=[A-Fa-f:]*[0-9])(?:" + "|".join(
    [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{_V4}", rf"::(?:{_H}:){{0,5}}{_V4}"]
    + [rf"(?:{_H}:){{1,{n}}}(?::{_H}){{0,{6 - n}}}:{_V4}" for n in range(1, 6)]
    + [rf"(?:{_H}:){{1,{n}}}(?::{_H}){{1,{7 - n}}}" for n in range(1, 7)]
    + [rf"(?:{_H}:){{2,7}}:", rf":(?::{_H}){{2,7}}"]) + r")(?![0-9A-Za-z:]|\.[0-9])")
#: What the entity types look like, in the order in which they are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "token": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|[spr]k_(?:live|test)_[0-9A-Za-z]{16,255}"
             r"|xox[abprs]-[0-9A-Za-z-]{10,255}|eyJ[0-9A-Za-z_-]{8,2000}\.[0-9A-Za-z_-]{8,4000}\.[0-9A-Za-z_-]{8,2000})(?![0-9A-Za-z])",
    "birth": rf"(?<!\w)(?:{_BORN}):? (?P<birth>(?:19|20)[0-9]{{2}}[-./][0-9]{{2}}[-./][0-9]{{2}}|[0-9]{{2}}[-./][0-9]{{2}}[-./](?:19|20)[0-9]{{2}})(?![0-9])",
    "street": rf"(?<![\w.])[0-9]{{1,5}}[A-Za-z]? (?:[A-Z][a-z]+ ){{1,3}}(?:{'|'.join(_STREET_WORD)})(?!\w)"
              rf"|(?<!\w)[^\W\d_][^\W\d_]{{2,20}}(?:{'|'.join(_STREET_TAIL)})\.? [0-9]{{1,4}}[a-z]?(?!\w)"
              rf"|(?<![\w.])[0-9]{{1,4}},? (?:{'|'.join(_STREET_HEAD[:6])}) (?:(?:de|du|des|la|le|les) )*[^\W\d_a-z][\w-]{{2,30}}"
              rf"|(?<!\w)(?:{'|'.join(_STREET_HEAD[6:])}) (?:(?:de|del|la|los|las) )*[^\W\d_a-z][\w-]{{2,30}},? [0-9]{{1,4}}(?!\w)",
    "hex": r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.]){_V4}(?![0-9]|\.[0-9])|{_V6}",
    "card": r"(?<![0-9A-Za-z+])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z])\+(?:[0-9]{7,15}|[0-9]{1,3}[ .-]?(?:[0-9]{3}[ .-][0-9]{4}|[0-9]{2,4}[ .-][0-9]{4,10}))(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z.+-])(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{7,10}|[0-9]{3}-[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
    "name": rf"(?<!\w){_TITLE}\.? (?:{_TITLE}\.? ){{0,3}}(?P<name>{_WORD_NAME}(?: {_WORD_NAME}){{0,7}})",
}
_OWNER = re.compile(r"(?:['’][sS])?['’-]*$")
_WORD = re.compile(r"(?<!\w)(?<!\w['’-])(?P<w>[^\W\d_]\w*(?:['’-]\w+)*?)(?:['’][sS])?(?!\w|['’-]\w)")
_FIND = re.compile("|".join(f"(?P<t_{k}>{p})" for k, p in PATTERNS.items()))
#: A line without any of these holds no entity.
_TRIGGER = re.compile(rf"[@0-9]|[A-Fa-f]{{32}}|eyJ|(?<!\w){_TITLE}\.? [^\W\d_]")
#: A text without any of these holds no entity; Spark's regular expressions read it.
_HINT = (r"@|[0-9a-fA-F]{32}|[0-9](?:[ .()/+-]{0,3}[0-9]){6}|\.[0-9]{1,3}\.|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
         r"|:[0-9a-fA-F]{0,4}:[0-9a-fA-F:]|AKIA|gh[pousr]_|[spr]k_(?:live|test)_|xox[abprs]-|eyJ"
         r"|[0-9][A-Za-z]?,? \p{L}|\p{L}[.,]? [0-9]"
         rf"|(?<!\p{{L}}){_TITLE}\.? \p{{L}}")


def _luhn(digits: str) -> int:
    """Luhn sum modulo 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def script_of(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
    return "latin"


def _subsequence(part: list[str], whole: list[str]) -> bool:
    at = iter(whole)
    return all(w in at for w in part)


def _fuller(form: str, forms: list[str]) -> str:
    """The form of a document that a shorter one stands for, if there is just one: the family name alike, else a given name."""
    gender, name = form.split("|", 1)
    words = name.split(" ")
    told = [f for f in forms if f[0] != "n" and f[2:] == name] if gender == "n" else []
    if len(told) == 1:
        return told[0]  # the doctor is the document's only one of that name
    longer = [f for f in forms if gender in (f[0], "n") and len(f[2:].split(" ")) > len(words) and _subsequence(words, f[2:].split(" "))]
    family = [f for f in longer if f.rsplit(" ", 1)[-1] == words[-1]]
    top = [f for f in family or longer if not any(g != f and _subsequence(f[2:].split(" "), g[2:].split(" ")) for g in longer)]
    return top[0] if len(top) == 1 else form


def _linked(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The entities with a document's shorter names under their fuller form, and with the untitled mentions of its names."""
    forms = sorted({c for _, _, kind, c in found if kind == "name"})
    if not forms:
        return found
    full = {f: _fuller(f, forms) for f in forms}
    found = [(a, b, kind, full[c] if kind == "name" else c) for a, b, kind, c in found]
    forms = sorted(set(full.values()))
    by_word: dict[str, list[str]] = {}
    for f in forms:
        for w in f[2:].split(" "):
            if w not in PARTICLES:
                by_word.setdefault(w, []).append(f)
    out, at, last = [], 0, None

    def resolve(words: list[str]) -> str | None:
        fits = [f for f in by_word[words[0]] if _subsequence(words, f[2:].split(" "))]
        exact = [f for f in fits if f[2:].split(" ") == words]
        family = [f for f in fits if f.rsplit(" ", 1)[-1] == words[-1] or f[2:] == words[-1]]
        fits = fits if len(words) == 1 and last in fits else exact or family or fits
        return last if last in fits else fits[0] if fits else None

    def bare(start: int, end: int) -> None:
        nonlocal last
        run: list[re.Match] = []

        def flush() -> None:
            nonlocal last
            while run:
                n = next(n for n in range(len(run), 0, -1) if resolve([m["w"].casefold() for m in run[:n]]))
                last = resolve([m["w"].casefold() for m in run[:n]])
                out.append((run[0].start(), run[n - 1].end("w"), "name", last))
                del run[:n]

        for m in _WORD.finditer(text, start, end):
            if run and text[run[-1].end("w"):m.start()] != " ":
                flush()
            if m["w"][0].isupper() and m["w"].casefold() in by_word:
                run.append(m)
            else:
                flush()
        flush()

    for entity in found:
        bare(at, entity[0])
        out.append(entity)
        at, last = entity[1], entity[3] if entity[2] == "name" else last
    bare(at, len(text))
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical) of the entities of a text, left to right, without overlaps.

    Canonical forms join what is one entity: case of e-mail addresses and names, separators of numbers.
    A name is found by its form of address; its document's other mentions of it follow: a shorter form
    ('Mr. Smith', 'John') has the canonical form of the fuller one ('m|john smith') if only one fits, and
    mentions without a form of address, with a capital, are entities too.
    """
    return _linked(text, _found(text))


def _in_name(words: list[str], i: int) -> bool:
    """Whether a word after a form of address goes on with the name: with a capital, or a particle before such a word."""
    w = words[i]
    if w[0].isupper():
        return not (i and w.casefold() in _NOT_NAMES)
    after = next((x for x in words[i + 1:] if x not in PARTICLES), "")
    return w in PARTICLES and after[:1].isupper() and after.casefold() not in _NOT_NAMES


def _found(text: str) -> list[tuple[int, int, str, str]]:
    """Entities line by line (none crosses a line end), only in lines with a trigger."""
    out, at = [], 0
    while hit := _TRIGGER.search(text, at):
        at = text.find("\n", hit.end())
        at = len(text) if at < 0 else at
        pos = text.rfind("\n", 0, hit.start()) + 1
        while m := _FIND.search(text, pos, at):
            entity = _entity(text, m)
            if entity:
                out.append(entity)
            pos = entity[1] if entity else m.start("name") if m["name"] else m.end()
    return out


def _entity(text: str, m: re.Match) -> tuple[int, int, str, str] | None:
    kind = next(k for k in PATTERNS if m[f"t_{k}"] is not None)
    start, end = m.span()
    if kind == "name":
        start, end = m.span("name")
        words = text[start:end].split(" ")
        words = words[:next((i for i in range(len(words)) if not _in_name(words, i)), len(words))][:6]
        while words and words[-1] in PARTICLES:
            words.pop()
        if not words:
            return None
        own = next((i for i, w in enumerate(words) if _OWNER.search(w)[0]), len(words) - 1)
        words = [*words[:own], _OWNER.sub("", words[own])]  # nothing follows a genitive
        end = start + len(" ".join(words))
        genders = [_GENDER[t] for t in text[m.start():start].replace(".", "").lower().split()]
        canonical = f"{next((g for g in genders if g != 'n'), 'n')}|{text[start:end].casefold()}"
    elif kind == "birth":
        start, end = m.span("birth")
        canonical = re.sub("[^0-9]", "", m["birth"])
    elif kind == "street":
        canonical = m[0].casefold()
    elif kind == "token":
        canonical = m[0]
    elif kind == "email":
        canonical = m[0].lower()
    elif kind == "ip" and ":" in m[0]:
        canonical = ipaddress.ip_address(m[0]).compressed
    elif kind in ("ip", "hex"):
        canonical = m[0].lower()
    else:
        canonical = re.sub(r"[^0-9A-Za-z+]", "", m[0])
        if kind == "card" and _luhn(canonical):
            kind = "number"  # long and replaced, but no card's
    return start, end, kind, canonical


class _Stream:
    """Keyed numbers for one entity, type and attempt."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.label, self.n, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, 0
        self.size = 0

    def below(self, n: int) -> int:
        if self.size < 64:
            block = hmac.new(self.key, self.label + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.size, self.n = int.from_bytes(block, "big"), 256, self.n + 1
        self.pool, v = divmod(self.pool, n)
        self.size -= max(1, n.bit_length())
        return v


def _alike(text: str, stream: _Stream) -> str:
    """Digits for digits, letters for letters of the same case and script; other characters stay."""
    out = []
    for i, c in enumerate(text):
        if c.isascii() and c.isdigit():
            first = c != "0" and (i == 0 or not text[i - 1].isdigit())
            out.append(str(1 + stream.below(9)) if first else str(stream.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + stream.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + stream.below(26)))
        elif "а" <= c <= "я":
            out.append(chr(ord("а") + stream.below(32)))
        elif "А" <= c <= "Я":
            out.append(chr(ord("А") + stream.below(32)))
        elif "α" <= c <= "ω":
            out.append("αβγδεζηθικλμνξοπρστυφχψω"[stream.below(24)])
        elif c.isalpha() and not c.isascii():
            out.append(chr(97 + stream.below(26)) if c.islower() else chr(65 + stream.below(26)) if c.isupper() else c)
        else:
            out.append(c)
    return "".join(out)


def made_name(script: str, kind: str, s: _Stream) -> str:
    """A family name (one of some billion by script) or a given name of a gender, out of syllables."""
    begins, vowels = SYLLABLES[script]
    pick = lambda options: options[s.below(len(options))]
    if kind == "family":
        mid, ends = FAMILY_ENDS[script]
        word = "".join(pick(begins) + pick(vowels) for _ in range(3 if script == "latin" else 4)) + pick(mid) + pick(ends)
    else:
        word = pick(begins) + pick(vowels) + pick(begins) + pick(vowels) + pick(GIVEN_ENDS[script, kind])
    return word.capitalize()


def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0, family: str | None = None) -> str:
    """A canonical replacement of the same type and form; another one for each attempt. Names take the ``family`` given."""
    s = _Stream(key, kind, canonical, attempt)
    longer = str(attempt) if attempt >= 24 else ""  # forms with few members run out of replacements
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        labels = domain.split(".")
        reserved = 2 if domain.endswith(("example.com", "example.org", "example.net")) else 1
        hidden = _alike(".".join(labels[:-reserved]), _Stream(key, "domain", domain))
        return _alike(local, s) + longer + "@" + ".".join(([hidden] if hidden else []) + labels[-reserved:])
    if kind == "ip" and ":" in canonical:
        v6 = re.sub("[0-9a-f]+", lambda m: "".join("0123456789abcdef"[(1 + s.below(15)) if i == 0 else s.below(16)]
                                                   for i in range(len(m[0]))), canonical.split(".")[0])
        return ipaddress.ip_address(v6).compressed
    if kind == "ip":
        return ".".join(str(1 + s.below(223) if i == 0 else s.below(256)) for i in range(4))
    if kind == "hex":
        return "".join("0123456789abcdef"[s.below(16)] for _ in canonical)
    if kind == "card":
        body = canonical[0] + "".join(str(s.below(10)) for _ in canonical[2:])
        want = _luhn(canonical)
        return next(body + d for d in "0123456789" if _luhn(body + d) == want)
    if kind == "phone":
        code = re.match(r"\+[0-9]{1,3}", canonical) and canonical[:max(2, len(canonical) - 10)] or ""
        return code + _alike(canonical[len(code):], s)
    if kind == "iban":
        return canonical[:2] + _alike(canonical[2:], s)
    if kind in ("name", "family"):
        gender, name = canonical.split("|", 1) if kind == "name" else ("m", canonical)
        words, script = name.split(" "), script_of(name)
        picked = [w if w in PARTICLES else made_name(script, gender, s) for w in words[:-1]]
        return " ".join([*picked, family or made_name(script, "family", s)])
    if kind == "token":
        head = re.match(r"AKIA|gh._|.k_(?:live|test)_|xox.-|eyJ[^.]*\.", canonical)[0]
        return head + _alike(canonical[len(head):], s)
    if kind == "birth":
        ymd = canonical[:2] in ("19", "20") and not (canonical[4:6] in ("19", "20") and int(canonical[2:4]) > 12)
        day, month = (canonical[6:], canonical[4:6]) if ymd else (canonical[:2], canonical[2:4])
        some = lambda old: f"{13 + s.below(16):02}" if int(old) > 12 else f"{1 + s.below(12):02}"
        day, month, year = some(day), some(month), str(1930 + s.below(90))
        return year + month + day if ymd else day + month + year
    if kind == "street":
        kept = {w.casefold() for w in (*_STREET_WORD, *_STREET_HEAD, *PARTICLES, "des", "los", "las", "les")}

        def new(m: re.Match) -> str:
            w = m[0]
            tail = next((t for t in _STREET_TAIL if w.endswith(t) and len(w) > len(t) + 2), "")
            return w if w in kept or len(w) == 1 else (made_name(script_of(w), "n", s).casefold() + tail)
        return re.sub(r"[^\W\d_][^\W\d_'-]*", new, re.sub("[0-9]+", lambda m: _alike(m[0], s), canonical))
    return _alike(canonical, s)


def dressed(kind: str, mention: str, replacement: str, canonical: str | None = None) -> str:
    """The canonical replacement in the mention's own case and separators; of a name, the words that the mention has."""
    if kind == "name":
        if canonical:
            said, words, new = mention.casefold().split(" "), canonical[2:].split(" "), replacement.split(" ")
            picked: list[str] = []
            for w, n in zip(reversed(words), reversed(new)):
                if said and said[-1] == w:
                    picked.insert(0, n)
                    said.pop()
            replacement = " ".join(picked)
        return replacement.upper() if mention.isupper() and len(mention) > 1 else replacement
    if kind == "street":
        said = iter(mention.split(" "))  # capitals where the mention has them
        return " ".join(w.upper() if (o := next(said, "")).isupper() and len(o) > 1 else w.capitalize() if o[:1].isupper() else w
                        for w in replacement.split(" "))
    if kind == "token":
        return replacement
    if kind in ("email", "hex", "ip"):
        return replacement.upper() if mention.isupper() else replacement
    out, left = [], list(replacement.replace("+", ""))
    for c in mention:
        out.append(left.pop(0) if c.isalnum() and left else c)
    return "".join(out + left)


def _collect(docs: DataFrame) -> DataFrame:
    """(doc_id, print, type, canonical): the distinct entities of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, canonical in dict.fromkeys(e[2:] for e in entities(text)):
                    for col, v in zip(out, (doc, mark, kind, canonical)):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["doc_id", "print", "type", "canonical"])

    return docs.mapInArrow(run, "doc_id long, print long, type string, canonical string")


def _candidates(entity_rows: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, c, key, attempt, f) for k, c, f in zip(*(c.to_pylist() for c in batch.columns))]
            folded = [m.casefold() for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()),
                                              pa.array(folded, pa.string())], names=["type", "canonical", "surrogate", "folded"])

    return entity_rows.select("type", "canonical", "family").mapInArrow(
        run, "type string, canonical string, surrogate string, folded string")


def _draw(entity_rows: DataFrame, used: DataFrame, key: bytes) -> DataFrame:
    """(type, canonical, surrogate) for distinct (type, canonical, family), none of them in ``used`` and none twice."""
    parts, pending, attempt = [], entity_rows, 0
    while True:
        drawn = cut(_candidates(pending, key, attempt).join(used, ["type", "folded"], "left_anti")
                    .withColumn("turn", F.row_number().over(Window.partitionBy("type", "folded").orderBy("canonical")))
                    .filter("turn = 1").drop("turn"))
        parts.append(drawn.select("type", "canonical", "surrogate"))
        pending = cut(pending.join(drawn, ["type", "canonical"], "left_anti").select("type", "canonical", "family"))
        if pending.isEmpty():
            break
        used, attempt = used.union(drawn.select("type", "folded")), attempt + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def assign_surrogates(entity_rows: DataFrame, key: bytes) -> DataFrame:
    """(type, canonical, surrogate) for distinct (type, canonical), no two of a type with the same surrogate.

    Each entity's surrogate is a keyed function of its type and canonical form, so it is the same in
    all documents and runs. A candidate that another entity of the corpus bears, that is taken, or that
    several entities drew (all but one of them) is drawn again with the next attempt. Family names have
    surrogates of their own, which all names with that family name share; a name of one word is a family
    name, so only there may a man and a woman have the same.
    """
    name = "substring_index(canonical, '|', -1)"
    family = f"substring_index({name}, ' ', -1)"
    rows = entity_rows.select("type", "canonical")
    names = cut(rows.filter("type = 'name'").withColumn("word", F.expr(family)))
    others = rows.filter("type <> 'name'")
    real = lambda df, form: df.select("type", F.expr(f"lower({form})").alias("folded")).distinct()
    families = names.select(F.lit("family").alias("type"), F.col("word").alias("canonical")).distinct()
    first = others if names.isEmpty() else others.union(families)
    drawn = _draw(first.withColumn("family", F.lit(None).cast("string")), cut(real(first, "canonical")), key)
    if names.isEmpty():
        return drawn
    drawn = cut(drawn)
    known = names.join(drawn.filter("type = 'family'").select(F.col("canonical").alias("word"), F.col("surrogate").alias("family")), "word")
    whole = cut(known.filter("instr(canonical, ' ') > 0").select("type", "canonical", "family"))
    return (drawn.filter("type <> 'family'")
            .union(known.filter("instr(canonical, ' ') = 0").select("type", "canonical", F.col("family").alias("surrogate")))
            .union(_draw(whole, cut(real(names, name)), key)))


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, n_distinct) for each document, its entities replaced by surrogates.

    E-mail addresses keep their form and a reserved or top-level domain, and addresses of one domain
    share the new one; names keep gender, script, number of words and particles, and share the new family
    name, made of syllables of their script; numbers keep separators, lengths, country codes and check sums;
    hexadecimal secrets their length and case, tokens their prefix; dates of birth are dates again, and street
    addresses keep the words that name the kind of street.
    A name is found by a form of address or a title; it has six words at most, particles included. In a
    document that has one, its mentions without one and its shorter forms are replaced alike. A name that has no form of address in its document stays.
    Equal entities have one surrogate in the whole corpus, different ones of a type different
    surrogates. Null text is empty; texts without entities come back unchanged; repeated rows give a
    row each; an empty table gives no rows. Only documents that may hold an entity are shuffled.
    """
    base = id_and_text(docs, id_col, text_col)
    maybe = F.col("text").rlike(_HINT)
    plain = base.filter(~maybe).select("doc_id", "text", F.lit(0).alias("n_entities"), F.lit(0).alias("n_distinct"))
    marked = cut(base.filter(maybe).withColumn("print", F.xxhash64("text")).select("doc_id", "print", "text"))
    found = cut(_collect(marked))
    known = assign_surrogates(cut(found.select("type", "canonical").distinct()), key)
    per_doc = (join_lookup(cut(found.distinct()), cut(known), ["type", "canonical"]).groupBy("doc_id", "print")
               .agg(F.collect_list(F.struct("type", "canonical", "surrogate")).alias("known")))
    joined = marked.alias("d").join(per_doc.alias("k"), F.expr("d.doc_id <=> k.doc_id AND d.print = k.print"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, many, distinct = [], [], []
            for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                table = {(k["type"], k["canonical"]): k["surrogate"] for k in known or []}
                spans, out, at = entities(text), [], 0
                for start, end, kind, canonical in spans:
                    out += [text[at:start], dressed(kind, text[start:end], table[kind, canonical], canonical)]
                    at = end
                texts.append("".join([*out, text[at:]]))
                many.append(len(spans))
                distinct.append(len(table))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(many, pa.int32()), pa.array(distinct, pa.int32())],
                names=["doc_id", "text", "n_entities", "n_distinct"])

    done = joined.select("d.doc_id", "text", "known").mapInArrow(
        run, "doc_id long, text string, n_entities int, n_distinct int")
    return plain.unionByName(done)
