"""High-recall span candidates of personal details, and the numbers that describe them.

Names are proposed by shape: two to four words beside each other that begin with a capital in any alphabet, with particles and initials
between, whether any list knows them or not; words in other case if a list knows one of them; and short runs of Han after a label.
What they are is left to the trees, by how common the words are (a public vocabulary of word pieces), what is known of
them, and what stands around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import regex

KINDS = ("email", "phone", "id_number", "address", "name")

_LETTER = "A-Za-zÀ-ɏ"
_S = "[ \t\u00a0\u2000-\u200a\u202f\u3000\x00]"
_DASH = "\\-\u2010\u2011\u2012\u2013"
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,9}\s*/?>")

# Fixed word lists: how addresses are written out and what surrounds each kind in five languages.
_STREET = "street|st|road|rd|lane|ln|way|avenue|ave|close|drive|court|square|terrace|boulevard|blvd|crescent|rise|mews|grove|hill|park|walk|gardens|green|alley|view|circle|gate"
_VOIE = "rue|chemin|impasse|quai|place|avenue|allée|boulevard|cours|route|sentier|passage"
_WEG = "straße|strasse|str\\.|weg|gasse|allee|platz|ufer|damm|steig|pfad"
_VIA = "c/|calle|avda\\.?|avenida|plaza|pza\\.?|paseo|camino|travesía|ronda"
_FLAT = "flat|apt\\.?|apartment|unit|suite|room"
_AT = "at|arroba|arobase"
_DOT = "dot|punto|point|punkt"
_TLD = frozenset("com org net edu gov info io dev app biz de fr es uk us cn jp eu ch at nl se no example test invalid".split())
_CONTEXT = {
    "phone": r"tel\b|tel[.:]|phone|tél|telefon|teléfono|电话|fax|call\b|ring\b|reach|mobile|joignable|erreichen|erreichbar|unter\b|night line|hotline|sms|notify|contact|llam|手机|rückfragen|demandez|asked|asks|preguntad|numéro|sticks",
    "id": r"passport|pass\b|pasaporte|passeport|reisepass|licen[cs]e|permis|führerschein|ausweis|badge|tax\b|steuer|identit|documento|dni\b|证件|护照|身份|\bid\b|id no|customs|mine is|carnet|social security|national insurance",
    "goods": r"article|part\b|serial|row\b|order|box\b|version|cam\b|shutter|fits|batch|item|model|sku|lot\b|invoice no|build|hash|origin|placed|piece|artikel|bestell|pieza|pièce n|file\b|board|frame|img|\bno\.$|序列|货号",
    "place": r"deliver|address|adresse|anschrift|pickup|pick up|ship|lives|parcel|steht bei|door\b|paquet|colis|寄到|地址|went to|photographed everything at|return|send .{0,12}to|wohnt|domicil|visit|second door|住",
    "person": r"\b(?:with|by|for|from|to|asked|ask|as|cc|and|operator|user|contact|thanks|hi|dear|key is|an|bei|por|par|demandez|saludos|cordialement|grüße|gruß|an|von|de|signed|belongs to|ring|author|reviewer|owner|name)\W{0,3}$|联系人.?$|由\W?$|--\s*$|from:\s*$|contact:\s*$|:\s*$",
    "said": r"^\W{0,2}(?:said|wrote|asked|agreed|says|thinks|at the door|confirmed|via|via\b|started|has|and|负责|phoned|mailed|signed|left)|^\s*[:<(;]|^\W{0,2}$",
    "title": r"(?:\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|m\.|sr|sra|señora?|madame|monsieur)\.?\s*)$",
    "made": r"puzzle|series|called|lens|box of|brand|named|street|road|lane|style|edition|map\b|blur|tray|places|fair\b",
}
_CONTEXT = {k: re.compile(v, re.I) for k, v in _CONTEXT.items()}
#: Full-width forms of ASCII characters.
_PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if chr(c - 0xFEE0) not in ",:;!?()"} | {0xFF08: 0x28, 0xFF09: 0x29}
#: Fixed word list: small words of five languages.
_STOP = frozenset(
    "the on of and in at to side for a an with is was are be or but if as by from this that these those my your our his her its their it we you he she they not no so then when once since after before all both each every some "
    "der die das und ein eine einen dem den des im am zum zur bei von mit auf für nach vor als wie wir ich sie er es nicht kein keine alle "
    "le la les et un une des du au aux dans sur pour par avec que qui ce cette ces nous vous ils elle il ne pas tous "
    "el los las y una unos del al en con por para que no se su sus este esta estos nos todos".split()
)

_EMAIL = re.compile(
    rf"(?<![{_LETTER}0-9._%+\-])(?P<local>[{_LETTER}0-9][{_LETTER}0-9._%+'\-]{{0,63}})"
    rf"(?P<at>{_S}?@{_S}?|{_S}?[\[({{]{_S}?(?:{_AT}){_S}?[\])}}]{_S}?|{_S}(?:{_AT}){_S}(?=[A-Za-z0-9\-]+{_S}?[\[({{ ]?(?:{_DOT}|\.)))"
    rf"(?P<domain>[A-Za-z0-9\-]+(?:(?:\.|{_S}?[\[({{]{_S}?(?:{_DOT}){_S}?[\])}}]{_S}?|{_S}(?:{_DOT}){_S})[A-Za-z0-9\-]+)*)",
    re.I,
)
#: What an address with its sign written out has at least.
_WRITTEN_OUT = re.compile(rf"[\[({{]{_S}?(?:{_AT}){_S}?[\])}}]|{_S}(?:{_AT}){_S}[A-Za-z0-9\-]+{_S}?(?:[\[({{ ]?(?:{_DOT}|\.))", re.I)
_NUMBER = re.compile(rf"(?<![A-Za-z0-9_+#{_DASH}])(?<!\d[.,/:])[+(]?\d[\d()./ \u00a0\u202f\x00{_DASH}]{{5,26}}\d")
_ID = re.compile(
    rf"(?<![A-Za-z0-9_#{_DASH}])(?<!\d[.,/ ])(?:[A-Za-z]{{1,3}}[{_DASH}]?\d{{5,10}}[A-Za-z]?|\d{{5,10}}[ {_DASH}]?[A-Za-z]|\d{{2,4}}(?P<sep>[ /.{_DASH}\u00a0])\d{{2,4}}(?:(?P=sep)\d{{2,5}}){{1,2}}(?:[{_DASH}]\d{{1,3}})?|\d{{7,12}})(?![A-Za-z0-9])(?![{_DASH}/.]\d)"
)
_NUM = rf"\d{{1,5}}(?:{_S}?[{_DASH}/]{_S}?\d{{1,5}})?(?:{_S}?[A-Da-d](?![{_LETTER}])|{_S}(?:bis|ter)(?![{_LETTER}]))?"
_W = rf"[{_LETTER}'’.\-]+"
_ADDRESS = [
    re.compile(rf"(?<![{_LETTER}0-9.,:/{_DASH}#])(?:(?:{_FLAT}){_S}+#?\w{{1,5}},{_S}*)?{_NUM},?{_S}+(?:{_W}{_S}+){{0,3}}?{_W}{_S}+(?:{_STREET})(?![{_LETTER}])", re.I),
    re.compile(rf"(?<![{_LETTER}0-9.,:/{_DASH}#])(?:(?:{_FLAT}|appt\.?){_S}+#?\w{{1,5}},{_S}*)?{_NUM},?{_S}+(?:{_VOIE}){_S}+(?:de{_S}la|de{_S}l'|d[eu]s?|d'|l')?{_S}*{_W}", re.I),
    re.compile(rf"(?<![{_LETTER}0-9\-])[{_LETTER}\-]{{2,30}}(?:{_WEG}){_S}+{_NUM}(?![\w:])", re.I),
    re.compile(rf"(?<![{_LETTER}0-9\-])(?:am|an{_S}der|an{_S}den|auf{_S}der|auf{_S}dem|zum|zur|im|in{_S}der|unter{_S}den){_S}+(?:{_W}{_S}+){{1,3}}?{_NUM}(?![\w:]|\.\d)", re.I),
    re.compile(rf"(?<![{_LETTER}0-9\-])(?:{_VIA}){_S}*(?:{_W}{_S}+){{1,5}}?(?:n[.º°]{_S}*)?{_NUM}(?![\w:])", re.I),
    re.compile(r"(?:(?<=寄到)|(?<=住在)|(?<=地址是)|(?<=送到)|(?<![一-鿿]))[一-鿿]{2,7}?[路街巷道]\d{1,5}[号弄](?:\d{1,5}[号栋室弄])*"),
]
#: What may follow an address and belongs to it: floor, flat, postal code and town.
_TAIL = re.compile(rf"(?:,?{_S}*(?:#\d{{1,4}}|(?:{_FLAT}|floor){_S}+#?\w{{1,5}}|bajo|\d{{1,2}}º(?:{_S}*[A-Z](?![{_LETTER}]))?))*(?:,{_S}*\d{{4,5}}{_S}+[{_LETTER}]{{3,}})?", re.I)
#: A letter of any alphabet with words, not of a script written without spaces.
_ANY = "[^\\W\\d_\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"
#: Runs of letters with hyphens and apostrophes inside, and what is no word because a digit is in it.
_TOKEN = re.compile(rf"\d[^\W_]*|{_ANY}+(?:['’\-\u2011]{_ANY}+)*(?:\d[^\W_]*|\.)?")
_ASCII_TOKEN = re.compile(_TOKEN.pattern.replace(_ANY, "[A-Za-z]"), re.ASCII)
#: Words as far as they can be looked up.
_SIMPLE = re.compile(rf"{_ANY}{{2,}}(?:['’\-\u2011]{_ANY}+)*")
#: Fixed word list: small words between the words of a name.
_PARTICLES = frozenset("de del della di da dos das do du la le van von der den ter ten bin ibn binti al el af av zu y".split())
_SMALL = "|".join(sorted(_PARTICLES))


def _runs(letter: str, capital: str, engine) -> re.Pattern:
    """Two or more words or initials that begin with a capital, in any gaps a name may have, small words between."""
    word = rf"(?:{capital}(?:{letter}|['’\-\u2011])*\.?)"
    gap = rf"(?:{_S}{{1,6}}|,{_S}{{1,6}}|{_S}*\n{_S}*)"
    return engine.compile(rf"(?<!{letter}){word}(?:{gap}(?:(?:{_SMALL}){gap}){{0,2}}{word})+")


_ASCII_RUN = _runs("[A-Za-z]", "[A-Z]", re)
_RUN = _runs(r"\p{L}", r"\p{Lu}", regex)
#: Fixed word list: titles before a name, no part of it.
_TITLES = frozenset("mr mrs ms miss dr prof herr frau mme mlle sr sra srta señor señora madame monsieur don doña".split())
#: Fixed word list: the commonest Chinese family names.
_HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_HAN_LABEL = "联系人|负责人|姓名|经手人|收件人|寄件人|签收人|操作员|作者|申请人|审核|联络人|署名"
_HAN_NAME = re.compile(rf"(?:(?P<label>{_HAN_LABEL})[是为]?\s*[::]?\s*|(?P<by>由|请找|找|感谢|谢谢|我是|致电|联系|问)\s*)(?P<name>[{_HAN_FAMILY}][一-鿿]{{1,2}})")
_HAN_NEXT = re.compile(r"\s*(?:负责|签收|确认|操作|拍摄|提供|说|表示|写|发|先生|女士|老师|[^一-鿿]|$)")
_GAP = re.compile(rf"{_S}{{1,6}}|,{_S}{{1,6}}|{_S}*\n{_S}*")


#: Words whose likeness to names is remembered; the memory is emptied when full.
_REMEMBERED = 100_000


class Names:
    """Given names and family-name forms known from a table; others are judged by their ends."""

    def __init__(self, given: set[str], family: set[str], common: frozenset[str] = frozenset()) -> None:
        #: Words that are one piece of a public vocabulary, as they are written there.
        self.common = common
        self.given = {g.lower() for g in given}
        parts = {p for f in family for p in re.split(r"[\s\-]+", f.lower()) if len(p) > 3}
        self.family = parts
        self.heads = {p[:4] for p in parts}
        self.tails = {p[-3:] for p in parts}
        self._judged: dict[str, tuple[float, float]] = {}

    def judged(self, word: str) -> tuple[float, float]:
        """``as_given`` and ``as_family`` of a word, remembered for words that come again."""
        found = self._judged.get(word)
        if found is None:
            if len(self._judged) >= _REMEMBERED:
                self._judged.clear()
            found = self._judged[word] = self.as_given(word), self.as_family(word)
        return found

    def as_given(self, word: str) -> float:
        w = word.lower()
        return float(w in self.given or w.split("-")[0] in self.given)

    def as_family(self, word: str) -> float:
        """1 a known family name, .7 its ends are known from family names, else 0."""
        best = 0.0
        for p in word.lower().replace("\u2011", "-").split("-"):
            best = max(best, 1.0 if p in self.family else 0.7 if len(p) > 5 and p[:4] in self.heads and p[-3:] in self.tails else 0.0)
        return best


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    features: list[float]


def masked(text: str) -> str:
    """The text with markup tags blanked out and full-width forms made plain, all places kept."""
    t = text if text.isascii() else text.translate(_PLAIN)
    return _TAG.sub(lambda m: "\x00" * len(m.group()), t) if "<" in t else t


def _around(t: str, a: int, b: int, what: tuple[str, ...]) -> list[float]:
    left, right = t[max(0, a - 30) : a].replace("\x00", " "), t[b : b + 18].replace("\x00", " ")
    line = left.rfind("\n")
    near = left[line + 1 :]
    before, after = t[a - 1] if a else "\n", t[b] if b < len(t) else "\n"
    out = [float(bool(_CONTEXT[w].search(near))) for w in what]
    out += [float(before == "\n"), float(after == "\n"), float(before in "([<{"), float(before in "=:"), float(before.isalnum()), float(after in ")]>;,"), float(after.isalnum())]
    return out


def _groups(s: str) -> tuple[list[int], list[str]]:
    return [len(g) for g in re.findall(r"\d+", s)], re.findall(r"[^\dA-Za-z]+", s)


def _number_features(s: str) -> list[float]:
    lens, seps = _groups(s)
    first = [*lens, 0, 0, 0, 0, 0, 0][:6]
    joined = "".join(seps)
    return [
        sum(lens), len(lens), *first, float(s[0] == "+"), float(s[0] == "("), float(s.startswith("00")), float(s.startswith("0")),
        float("(0)" in s), float("/" in joined), float("." in joined), float(bool(re.search(f"[{_DASH}]", joined))), float(bool(re.search(r"[ \u00a0]", joined))), len(set(seps)),
        float(s[0].isalpha()), float(s[-1].isalpha()), max(lens, default=0), float("(" in s),
    ]


_NUMBER_CONTEXT = ("phone", "id", "goods", "place")


def find(text: str, names: Names) -> list[Candidate]:
    """All candidates of all kinds, overlapping ones too."""
    t = masked(text)
    seen = set(_SIMPLE.findall(t))
    low = {w.lower() for w in seen}
    return [*_emails(t, names), *_phones(t), *_ids(t), *_addresses(t, low), *_names(t, names, seen)]


def _plain(word: str, names: Names) -> float:
    return float(word.lower() in names.common or word.lower() in _STOP)


def _emails(t: str, names: Names) -> list[Candidate]:
    out = []
    for m in _EMAIL.finditer(t) if "@" in t or _WRITTEN_OUT.search(t) else ():
        at, domain, local = m["at"], m["domain"], m["local"]
        labels = [x for x in re.split(rf"\.|[\[({{]\s?(?:{_DOT})\s?[\])}}]|\s(?:{_DOT})\s", domain, flags=re.I) if x and x.strip()]
        last = labels[-1].strip().lower()
        sign = at.strip()
        f = [
            float("@" in at), float(sign[:1] in "[({"), float(at[:1].isspace()), float(at[-1:].isspace()), float(at[:1].isspace() != at[-1:].isspace()),
            len(labels), float(last in _TLD), float(last.isdigit()), float(last.isalpha()), len(last), len(local), float(any(c.isdigit() for c in local)), float(any(c in "._+-" for c in local)),
            float(local.isdigit()), float(domain[:1].isdigit()), _plain(local, names), _plain(labels[0].strip(), names), float(any(x.strip().lower() in _STOP for x in labels)), float(last in names.common),
        ]
        out.append(Candidate("email", m.start(), m.end(), f + _around(t, m.start(), m.end(), ("phone", "goods", "person"))))
    return out


def _phones(t: str) -> list[Candidate]:
    out = []
    for m in _NUMBER.finditer(t):
        a, s = m.start(), m.group()
        if s[0] == "(" and not re.match(r"\(\d{1,5}\)", s):
            a, s = a + 1, s[1:]
        if s.count("(") < s.count(")"):
            s = s[: s.index(")")] if "(" not in s else s[: s.rindex(")")]
        ends, digits = [], 0
        for g in re.finditer(r"\d+", s):
            digits += len(g.group())
            if 8 <= digits <= 15:
                ends.append(g.end())
        for e in {ends[0], ends[-1], ends[len(ends) // 2]} if ends else ():
            part = s[:e]
            nxt = t[a + e : a + e + 2]
            f = _number_features(part) + [float(e == len(s)), float(bool(re.match(r"[.,:/]\d", nxt))), float(bool(re.match(r" ?\d", nxt)))]
            out.append(Candidate("phone", a, a + e, f + _around(t, a, a + e, _NUMBER_CONTEXT)))
    return out


def _ids(t: str) -> list[Candidate]:
    out = []
    for m in _ID.finditer(t):
        s = m.group()
        letters = sum(c.isalpha() for c in s)
        f = _number_features(s) + [letters, float(s[: letters or 1].isupper()), float(len(s))]
        out.append(Candidate("id_number", m.start(), m.end(), f + _around(t, m.start(), m.end(), _NUMBER_CONTEXT)))
    return out


#: Words of which a text must have one for each shape of address that begins or ends with a word; the others are looked for by a mark.
_NEEDED = {
    0: frozenset(_STREET.split("|")), 1: frozenset(_VOIE.split("|")), 3: frozenset("am an auf zum zur im in unter".split()), 4: frozenset("calle avda avenida plaza pza paseo camino travesía ronda".split()),
}
_WEG_NUMBER = re.compile(rf"(?:{_WEG}){_S}+\d", re.I)


def _addresses(t: str, low: set[str]) -> list[Candidate]:
    """``low`` has the text's words in small letters."""
    out = []
    for shape, pattern in enumerate(_ADDRESS):
        if shape in _NEEDED:
            if low.isdisjoint(_NEEDED[shape]) and not (shape == 4 and "/" in t):
                continue
        elif shape == 2 and not _WEG_NUMBER.search(t) or shape == 5 and "号" not in t and "弄" not in t:
            continue
        for m in pattern.finditer(t):
            s = m.group()
            words = [w for w in re.findall(rf"[{_LETTER}]+", s)]
            inner = [w for w in words if len(w) > 1 and not re.fullmatch(rf"{_STREET}|{_VOIE}|bis|ter|{_FLAT}", w, re.I)]
            street = [w for w in words if re.fullmatch(_STREET, w, re.I)]
            f = [
                float(shape), len(words), sum(w.lower() in _STOP for w in inner), sum(w[:1].isupper() for w in inner) / max(1, len(inner)), float(bool(street) and street[-1][0].isupper()), float(s.isupper()),
                len("".join(re.findall(r"\d+", s)[:1])), float(bool(re.match(_FLAT, s, re.I))), float(bool(re.match(r",\s*\d{4,5}\s", t[m.end() : m.end() + 9]))), float(bool(re.match(r",?\s*[A-Z]", t[m.end() : m.end() + 3]))), len(s),
            ]
            end = _TAIL.match(t, m.end()).end()
            out.append(Candidate("address", m.start(), end, f + _around(t, m.start(), m.end(), ("place", "goods", "person", "made"))))
    return out


def _words(t: str, names: Names, seen: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, word) of words of two or more letters, and of initials with their stop: all of them if a known name is written small, else those in runs of capitalised words."""
    plain = t.isascii()
    token = _ASCII_TOKEN if plain else _TOKEN
    judged = names.judged
    if any(w[0].islower() and judged(w) != _UNKNOWN for w in seen):
        return _tokens(token.finditer(t), t)
    out: list[tuple[int, int, str]] = []
    for m in (_ASCII_RUN if plain else _RUN).finditer(t):
        out += _tokens(token.finditer(t, *m.span()), t)
    return out


_UNKNOWN = (0.0, 0.0)


def _tokens(found: Iterator[re.Match], t: str) -> list[tuple[int, int, str]]:
    out = []
    for m in found:
        w = m.group()
        if w[-1] == ".":
            if len(w) == 2:
                if not (a := m.start()) or t[a - 1] not in ".'’-":
                    out.append((*m.span(), w))
                continue
            out.append((m.start(), m.end() - 1, w[:-1]))
        elif len(w) > 1 and not w[-1].isdigit() and not w[0].isdigit():
            out.append((*m.span(), w))
    return out


def _capital(word: str) -> bool:
    return word[0].isupper()


def _name_spans(t: str, tokens: list[tuple[int, int, str]], hit: list[bool]) -> list[tuple[int, int]]:
    """(first token, number of tokens) of possible names."""
    capital = [w[0].isupper() for _, _, w in tokens]
    # only beside a word that may begin or end a name is the gap looked at
    may = [c or h for c, h in zip(capital, hit)]
    joined = [
        (may[k] or may[k + 1]) and (b == a + 1 and t[a] == " " or bool(_GAP.fullmatch(t, a, b))) for k, ((_, a, _), (b, _, _)) in enumerate(zip(tokens, tokens[1:]))
    ]
    initial = [w[-1] == "." for _, _, w in tokens]
    foreign = [ord(w[0]) > 0x24F for _, _, w in tokens]
    title = [len(w) < 9 and w.lower() in _TITLES for _, _, w in tokens]
    shouted = lambda k: 0 <= k < len(tokens) and len(tokens[k][2]) > 1 and tokens[k][2].isupper()
    out = []
    for i in range(len(tokens)):
        if title[i] or not (may[i] or i + 1 < len(hit) and hit[i + 1]):
            continue
        for n in (2, 3, 4, 5):
            j = i + n - 1
            if j >= len(tokens) or not joined[j - 1] or foreign[i] != foreign[j] or title[j]:
                break
            if initial[i] and initial[j] or capital[i] != capital[j] and not (hit[i] and hit[j]):
                continue
            if not (hit[i] or hit[j]) and (tokens[i][2].lower() in _STOP or tokens[j][2].lower() in _STOP or shouted(i - 1) and shouted(i) or shouted(j) and shouted(j + 1)):
                continue  # a small word, or a part of a line in capitals
            if n == 2:
                ok = hit[i] or hit[j] or capital[i] and capital[j]
            else:
                ok = capital[i] and capital[j] and all(capital[k] or tokens[k][2].lower() in _PARTICLES for k in range(i + 1, j)) or n == 3 and initial[i + 1] and (hit[i] or hit[j])
            if ok:
                out.append((i, n))
    return out


def _names(t: str, names: Names, seen: set[str]) -> list[Candidate]:
    tokens = _words(t, names, seen)
    known = [(0.0, 0.0) if w[-1] == "." else names.judged(w) for _, _, w in tokens]
    hit = [g > 0 or f > 0 for g, f in known]
    out = [] if t.isascii() else _han_names(t)
    for i, n in _name_spans(t, tokens, hit):
        span = tokens[i : i + n]
        first, last = span[0][2], span[-1][2]
        initial = first.endswith("."), last.endswith(".")
        (g1, f1), (g2, f2) = known[i], known[i + n - 1]
        a, b = span[0][0], span[-1][1]
        gaps = [t[span[k][1] : span[k + 1][0]] for k in range(n - 1)]
        before, after = t[max(0, a - 1) : a], t[b : b + 1]
        next_word = re.match(rf"{_S}*([{_LETTER}]+)", t[b : b + 20])
        prior = re.search(rf"([{_LETTER}]+|\d+[a-z]?){_S}*$", t[max(0, a - 20) : a])
        plain = [0.0 if any(known[k]) else _plain(tokens[k][2], names) for k in range(i, i + n) if tokens[k][2][-1] != "."]
        out.append(
            Candidate(
                "name", a, b,
                [
                    n, g1, f1, g2, f2, float(initial[0]), float(initial[1]), float(any("," in g for g in gaps)), float(any("\n" in g for g in gaps)),
                    float(first[:1].isupper()), float(last[:1].isupper()), float(first.isupper() and last.isupper()), float(first.islower() and last.islower()),
                    float(before in tuple("@._+-") and before != ""), float(after in tuple("@_+") and after != "" or bool(re.match(r"[.\-][A-Za-z0-9]", t[b : b + 2]))), float(bool(re.match(rf"{_S}?(?:@|[\[(](?:{_AT})|(?:{_AT}){_S}\w+{_S}?(?:{_DOT}|[\[(.]))", t[b : b + 30], re.I))),
                    float(bool(next_word and re.fullmatch(f"{_STREET}|optics|fair|box|tray", next_word[1], re.I))), float(bool(prior and prior[1][0].isdigit())), len(first), len(last),
                    max(known[i - 1][0], known[i - 1][1]) if i and tokens[i - 1][1] >= a - 2 else 0.0, max(known[i + n]) if i + n < len(tokens) and tokens[i + n][0] <= b + 2 else 0.0,
                    float(bool(_CONTEXT["said"].search(t[b : b + 18].replace("\x00", " ")))), float(bool(_CONTEXT["title"].search(t[max(0, a - 12) : a]))),
                    *_shape(t, tokens, i, n, names), sum(plain) / max(1, len(plain)), plain[0] if plain else 0.0, plain[-1] if plain else 0.0, 0.0, 0.0,
                ]
                + _around(t, a, b, ("person", "made", "place")),
            )
        )
    return out


_ENDED = re.compile(r"(?:^|[\n.!?。!?:…][\s\x00\"'»)*]*|\n[\s>#*\-]*)$")


def _stemmed(word: str, names: Names) -> float:
    """1 if a word less one to three letters at its end is common, in either case."""
    low = word.lower()
    return float(any(len(low) - k >= 4 and (low[:-k] in names.common or low[:-k].capitalize() in names.common) for k in (1, 2, 3)))


def _shape(t: str, tokens: list[tuple[int, int, str]], i: int, n: int, names: Names) -> list[float]:
    """What the words' look and their neighbours say: stop words, capitals beside it, sentence start, other alphabets."""
    words = [w for _, _, w in tokens[i : i + n]]
    a, b = tokens[i][0], tokens[i + n - 1][1]
    left = i and tokens[i - 1][1] >= a - 2 and "\n" not in t[tokens[i - 1][1] : a] and _capital(tokens[i - 1][2])
    right = i + n < len(tokens) and tokens[i + n][0] <= b + 2 and "\n" not in t[b : tokens[i + n][0]] and _capital(tokens[i + n][2])
    title = sum(w[:1] + w[1:].lower() in names.common for w in words)
    inner = max((names.judged(w)[0] for w in words[1:-1] if w[-1] != "."), default=0.0)
    return [
        float(words[0].lower() in _STOP), float(words[-1].lower() in _STOP), float(left), float(right), float(bool(_ENDED.search(t, max(0, a - 8), a)) or a == 0), float(ord(words[0][0]) > 0x24F), title / n, float(any(w.lower() in _PARTICLES for w in words[1:-1])),
        float(sum(_capital(w) for w in words) == n), min(len(w) for w in words), inner, *(0.0 if any(names.judged(w)) else _stemmed(w, names) for w in (words[0], words[-1])),
    ]


def _han_names(t: str) -> list[Candidate]:
    """Short runs of Han that begin with a family name, after a label or a word that a person follows."""
    out = []
    for m in _HAN_NAME.finditer(t):
        for b in range(m.start("name") + 2, m.end("name") + 1):
            a = m.start("name")
            if not _HAN_NEXT.match(t, b):
                continue
            f = [0.0] * (24 + 13 + 3) + [1.0 + float(m["label"] is not None), 1.0]
            f[0], f[18], f[19] = 1.0, b - a, b - a
            out.append(Candidate("name", a, b, f + _around(t, a, b, ("person", "made", "place"))))
    return out
