"""Labelled training texts for the personal-detail models, made by a seeded generator.

Names are of three sorts: ones the list of known names has, ones that end alike, and ones of any other make in several alphabets.  A share of
the sentence patterns (every ``HELD``-th of a kind) can be kept out whole, to measure on patterns the models never saw.

The models are fitted on these sentences alone, a bounded number (``SENTENCES``) whatever the
corpus; no label and no row of the data is used.
"""

from __future__ import annotations

import random

from interlock.llm.candidates import _HAN_FAMILY, KINDS, Names

SENTENCES, HELD = 15_000, 5

# Fixed word lists the sentences are made of.
_GIVEN = "Agnes Boris Carla Dario Edda Felix Gilda Henrik Irena Jonas Katrin Ludo Mirja Niels Oona Pavel Rosa Sanna Tilda Uwe Vera Willem Yves Zora Anton Bruna Cedric Dunja Elmar Frida".split()
_HEADS = "Aller Bosko Corven Dalmi Ester Faller Gorme Hanke Istra Jelve Korma Lendi Morva Nessel Osker Pralle".split()
_TAILS = "ner vig berg sson holt ová mand rieux strand etti quard wen lund dottir".split()
_PARTS = "ka ri mo la shi en da to ve lu na jo sa mi ro be ni ta wo fe li ha su pe ra ke zo ne ma vi chi ya ow el ad um ola priy moh fat yuk hir chin raj sven ing ola niko lau cam gre ben wil".split()
_CYRILLIC = "ив ан ов пе тр ма рия ол ег се рг ей ни ко лай ан на кир ил во лод ми ха ил бо рис дан ко вич ен ко".split()
_WORDS = "Board Side Corner Edge Left Right Upper Lower New Old North South Staging Table Camera Lens Photo Map Blur Solver Matcher Stitcher Filter Build Batch Monday Friday Spring Summer Main Second Third Open Source Data Model User Guide Test Release Notes Manual Chapter Figure Wood Paper Glass Market Village River Lake Bridge Castle Garden Club Team Studio Press Media Group Cold Start Light Color Colour Error Report Summary Log Wiki".split()
_NOUNS = "Kiste Ablage Rand Kamera Licht Bild Teil Lauf Foto Liste Seite Ecke Greifer Schwelle Lücken Montag Guten Tag Große Rote Neue Le Bord Une Pièce El Borde La Caja Nueva Lista".split()
_HAN_GIVEN = "小明伟芳娜敏静丽强磊军洋勇艳杰娟涛超霞平刚桂英文华建国玉兰秀珍海"
_ENDINGS = "museum photography company online cloud tech agency studio website engineering zone ch at nl se it pl pt".split()
_HOSTS = "example test mail shop lab forge atelier post garden office".split()
_TLDS = "com org net example test de fr es io".split()
_STREETS = "Harbour Mill Linden Church Old Tower High Meadow Cooper Silver Long Acre North Quay Fox Hill".split()
_TOWNS = "Astby Corvale Dunmere Elsford Hallow Kirnach Lomburg Merrow Oxley Pernach".split()
_KINDS_EN = ["Street", "St.", "Road", "Rd", "Lane", "Way", "Avenue", "Ave.", "Rise", "Close", "Hill", "Walk"]
_FILL = [
    "The run took {n} min and placed {n} of {n} pieces.", "The photo IMG_{n4}.jpg is too bright.", "{t} INFO placed {n}/{n4} depth={n} queue={n}", "{t} INFO placed {n4}/{n4} depth={n} queue={n4}", "At ({n4}, {n}) there is a lone knob.",
    "Der Lauf dauerte {n} min.", "El lado {d} de {n4} encaja con otros {n}.", "Le calcul a duré {n} s.", "整个过程用了 {n} min。", "{t} WARN frame-{n4}.png: {n} islands", "Build {d}.{d}.{n} fixes the crash.", "step {d}/7 done in {n} min",
]
_CASES = {
    "email": [
        "Write to {} for the originals.", "{}", "mail {}, please", "user={} started the run", "Bitte an {} schicken.", "Escribid a {} cuanto antes.", "Écrivez à {} pour la suite.", "请联系 {} 索取原图。", "(mailto:{})", "From: {N} <{}>",
        "My address, {}, bounces.", "contact: {N}; {P}; {}", "cc {N} <{}>", "邮箱 {}。", "{N} ({}) knows.", "reply at {} or {}", "correo: {}", "Call {P} or mail {}, whichever is quicker.", "{N} via {}",
    ],
    "phone": [
        "You can reach me at {} after six.", "tel {}", "{}", "Call {} first.", "fax is {}, but nobody reads it", "Je suis joignable au {}.", "Ich bin unter {} zu erreichen.", "Mi teléfono es {}.", "我的电话是 {}。", "Rückfragen an {N} ({}).",
        "I asked {N} ({}) to rescan it.", "notify {} sent", "If it sticks, {} is the night line.", "contact: {N}; {}; {E}", "ring {N} on {}", "Demandez {N}, {}.", "mobile {} ext. 12", "--\n{N}\n{A}\n{}\n", "Preguntad por {N} ({}).", "phone={}", "whatsapp {}",
    ],
    "id_number": [
        "Passport {} was noted.", "badge {} accepted", "Ausweis {} liegt vor.", "Tax number {} goes on the invoice.", "Licence {} belongs to {N}.", "mine is {}. {n} more", "and mine is {}.", "Documento {} anotado.", "Pièce d'identité {} relevée.", "证件号 {} 已登记。", "customs wanted {} again",
        "His ID no. {} Since then", "they took down my licence, mine is {}.", "护照 {} 有效", "DNI {} caducado", "identity card {} was shown", "Steuer-ID {} fehlt", "permis {} valide", "Führerschein {} kopiert", "passport no. {}, issued here", "id: {}",
    ],
    "address": [
        "Ship the tray to {}, please.", "delivery={}", "Return address: {}", "Lieferanschrift: {}", "pickup {}; ring {N}", "El paquete va a {}.", "Le colis est parti au {}.", "Die Kiste steht bei {N}, {}.", "Ask for {N} at the door, {}.", "请寄到 {}。",
        "The key is with {N}, second door at {}.", "We photographed everything at {} last week.", "the parcel went to {} instead of the lab", "--\n{N}\n{}\n{P}\n", "{}", "she lives at {}", "住在{}。", "Adresse : {}", "moved to {} in May",
    ],
    "name": [
        "operator \"{}\" confirmed", "{} wrote on page {n}: fine", "As {} said, the crop is off.", "Ask for {} at the door.", "Cordialement, {}", "Viele Grüße, {}", "Saludos, {}", "联系人:{}", "由 {} 负责", "sent to {} and {}", "{}: agreed, close it.", "Thanks, {}", "reported by {} via {E}",
        "I asked {} to look.", "Signed for by {}, box no. {n}.", "Licence {I} belongs to {}.", "On a cold start {} hides the crop.", "Honestly, {} repeats two edges.", "Apart from IMG_{n}.jpg, {} explains it.", "Dr. {} and Ms {} agreed", "--\n{}\n{A}", "cc {}, {}", "{} brings back the outline.", "Hi {}, the scale is off", "the key is with {}.",
        "contact {}", "Contact {} about it.", "Please ask {} first.", "联系人:{H}", "由{H}负责", "请找{H}。", "负责人:{H},电话另告", "操作员:{H}", "author: {}", "Owner: {}\n", "Best, {}", "Regards,\n{}", "It was {} who noticed.", "I met {} at the bench.", "{} has the second key.", "Photos: {}", "({})", "with help from {}",
        "Merci à {} pour les photos.", "Gracias a {}.", "Danke an {} für die Kiste.", "nach Rücksprache mit {}", "según {}", "d'après {}", "Прислал {}", "{} и {}",
        "Again, {} waits for side {d}.", "Oddly enough, {} repeats it.", "Honestly, {} masks the edge.", "{} skips the whole top row", "Since the last build, {} stretches the crop by {n} px", "{}",
    ],
    "none": [
        "article no. {I} is sold out", "spare part {I}.", "See row {I} of the log.", "See row {n4}-{n}-{n4} of the log.", "Camera serial CAM-{n}-{n}-{n}, shutter count {n8}.", "Board {n} x {n}, order {n8}{d}{d}, box {n} {n} {n}.", "Version {d}.{d}.{n}-{n} of {n}.{n}.{n}",
        "fits: {n4} {n} {n4} {n}", "fits: {n} {n4} {n} {n} {n4}", "fits: {n} {n} {n4} {n4} {n}", "order {n8}, box {n4} {n4} {n4}.", "Version {d}.{d}.{n}-{n} of {n4}.{n4}.{n}", "See row {n}-{n}-{n4} of the log.", "Board {n} x {n}, order 20{n8}, box {n} {n4} {n4}.", "article no. {I} is sold out, size {n}", "{t} INFO placed {n4}/{n4} depth={n}", "spare part {I}. The rest is fine", "Handle @{w} is taken, use @{w}.{w} instead.", "The decorator @{w}@{d} made no difference.", "err@{d}.{n} was the worst, mail the list.", "The puzzle is called {S} Road, {n4} pieces.", "{T} Fair was the hardest of the {S} Lane series.", "Gaussian Blur and Edge Map are off.",
        "{D} {E} liegen eng.", "]]` {D} {E} liegen eng.", "部品が足りない {D} {E} sind da.", "fixed the arm {D} {E} helfen mehr.", "café corner {D} {E} fehlt.", "viele Grüße {D} {E} sind weit.", "{D} {E} helfen mehr.", "{E} {E} ist da.", "Die {D} {E} fehlt. {D} {E} auch.", "{D} {E} sind {n} Pixel weit.", "{E} {W} is next.", "{D} {E}.", "{O} {E} ist neu.", "{W} {W} is next.", "See the {W} {W} for more.", "{W} {W}\n\nIt works.", "# {W} {W} {W}\n", "Die {O} {O} ist neu.", "{O} {O} fehlt.", "by {W} {W}", "from {W} {W}", "{W} {W}: done", "contact {W} {W}", "with {W} {W} off", "In {T} {T} it rained.", "由于光线不足,重拍。", "操作员:高亮显示", "找石头边上的那块", "联系人:方框内", "Thanks, {W} {W} works.", "On {W} {W} we stop.", "({W} {W})", "ask {W} {W}",
        "look at the dot matrix", "meet at noon dot", "err@{w}", "@{w}.{w} wrote", "pip install {w}@{d}.{d}", "a at b dot c", "stare at it dot by dot", "git@{d}", "price @ {n}.{n}",
        "North Tray and Corner Box are places.", "The lens is a {T} Optics {n} mm.", "There are {n} blank sides in lane {d} and {n} on the street side.", "The file IMG_{n8}_{n}.jpg has {n} x 0{n} px blocks.", "hash={n8}{n8}", "Tray {d} {S} {S} style, {n} g.", "{S} at {T}, {n} pieces, item {I}.", "{t} TRACE cam CAM-{n}-{n}-{d} build {d}.{d}.{n}",
        "Looked at {n} corners at least", "model {I} of the rig", "order {n8}, lot {I}", "{G} Street was the hardest of the {G} Lane series.", "The puzzle is called {G} Road, {n} pieces.", "{T} {F} is a puzzle of {n} pieces.", "between {t} and {t} the arm sat still in row {n}", "um {t} blieb der Greifer über dem Rand {n} mal stehen", "part {I} in box {n}", "Serial no. {I}, batch {n}",
        "gripper at {n}, {n} of {n} way", "{n} pieces the long way", "am linken Rand {n} px", "im Lauf {n} fehlte es", "zur Schwelle {n}",
    ],
}


class Maker:
    """Draws values of each kind from a seeded generator."""

    def __init__(self, seed: int, common: frozenset[str] = frozenset(), held: bool | None = None) -> None:
        self.r = random.Random(seed)
        keep = lambda k: held is None or (k % HELD == HELD - 1) == held
        self.cases = {kind: [c for k, c in enumerate(cases) if keep(k)] for kind, cases in _CASES.items()}
        self.families = [h + t for h in _HEADS for t in _TAILS]
        self.r.shuffle(self.families)
        self.names = Names(set(_GIVEN[:22]), set(self.families[: len(self.families) * 2 // 3]), common)

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choice("0123456789") for _ in range(n - 1)) if n else ""

    def made(self, ends: tuple[str, ...]) -> str:
        """A word of no meaning with the end of an ordinary one."""
        return ("".join(self.r.choice(_PARTS) for _ in range(self.r.randint(1, 3))) + self.r.choice(ends)).capitalize()

    def strange(self) -> str:
        """A name of a make no list knows."""
        r = self.r
        make = lambda parts, low, high: "".join(r.choice(parts) for _ in range(r.randint(low, high))).capitalize()
        if r.random() < 0.15:
            return f"{make(_CYRILLIC, 2, 3)} {make(_CYRILLIC, 2, 4)}"
        g, f = make(_PARTS, 2, 3), make(_PARTS, 2, 4)
        f = r.choices([f, f"Al-{f}", f"{f}-{make(_PARTS, 2, 3)}", f"O'{f}", f"{r.choice(['de', 'van', 'von', 'del', 'bin', 'da'])} {f}", f"{make(_PARTS, 2, 3)} {f}", f"{f} {make(_PARTS, 2, 3)}", f"del {f} {make(_PARTS, 2, 3)} {make(_PARTS, 2, 3)}"], [12, 1, 1.5, 1, 2, 1, 1, 0.5])[0]
        return r.choices([f"{g} {f}", f"{g[0]}. {f}", f"{g} {f}".upper()], [14, 1, 1])[0]

    def name(self) -> str:
        r = self.r
        if r.random() < 0.25:
            return self.strange()
        g, f = r.choice(_GIVEN), r.choice(self.families)
        if r.random() < 0.1:
            f += "-" + r.choice(self.families)
        s = r.choices([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {r.choice('ABCKMST')}. {f}", f"{f} {g}", f"{g} {f}"], [10, 3, 3, 1.5, 0.7, 1])[0]
        return r.choices([s, s.upper(), s.lower()], [12, 2, 1])[0]

    def email(self) -> str:
        r = self.r
        g, f = r.choice(_GIVEN).lower(), r.choice(self.families).lower().replace("á", "a")
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}{r.randint(1, 99)}", f"{g[0]}{f}", f"{g}+{r.choice(_HOSTS)}", f"{g}.{f[0]}", f])
        host = [r.choice(_HOSTS) for _ in range(r.choice([1, 1, 2]))] + [r.choice(_TLDS) if r.random() < 0.7 else r.choice(_ENDINGS)]
        at, dot = r.choices([("@", "."), (" @ ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot ")], [8, 1.5, 2, 2, 2])[0]
        s = local + at + dot.join(host)
        return r.choices([s, s.upper(), s.title()], [8, 1, 1])[0]

    def phone(self) -> str:
        r, d = self.r, self.digits
        a = r.choice("- .‑")
        shapes = [
            f"+44 {d(2, '2')} {d(4)} {d(4)}", f"+44 (0){d(2, '2')} {d(4)}-{d(4)}", f"+447{d(9)}", f"07{d(3)} {d(6)}", f"07{d(3)}-{d(3)}-{d(3)}", f"0044 20 {d(8)}", f"(0{d(2, '234')}) {d(4)} {d(4)}", f"(0{d(2)}) {d(5)} {d(3)}", f"0{d(2)}/{d(8)}", f"0{d(2)} {d(5)} {d(3)}",
            f"+49 {d(2)} {d(5)}-{d(3)}", f"+49 ({d(2)}) {d(5)} {d(3)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 (0){d(1)} {d(2)}-{d(2)}-{d(2)}-{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(3)} {d(6)}", f"0{d(9)}",
            f"({d(3, '23456789')}) {d(3)}-{d(4)}", f"{d(3, '23456789')}{a}{d(3)}{a}{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"1 ({d(3)}) {d(3)} {d(4)}", f"+1{d(10)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+86 1{d(2)} {d(4)} {d(4)}", f"020 {d(4)} {d(4)}",
        ]
        return r.choice(shapes)

    def id_number(self) -> str:
        r, d = self.r, self.digits
        up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
        return r.choice([f"{up(1)}{d(7)}", f"{up(2)}{d(6)}{up(1)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(8)}-{up(1)}", f"{up(2)}{d(7)}", f"{d(9)}"])

    def address(self) -> str:
        r = self.r
        n, s = str(r.randint(1, 250)), r.choice(_STREETS)
        if r.random() < 0.2:
            s += " " + r.choice(_STREETS)
        if r.random() < 0.15:
            s = r.choice(_GIVEN)
        kind = r.random()
        if kind < 0.45:
            a = r.choice([n, n, f"{n}-{int(n) + 2}", n + "b"]) + f" {s} {r.choice(_KINDS_EN)}"
            a = r.choices([a, f"Flat {r.randint(1, 40)}, {a}", f"{a} #{r.randint(1, 30)}", f"{a}, Unit {r.randint(1, 30)}", f"Apt {r.randint(1, 40)}, {a}"], [5, 2, 1, 1, 0.5])[0]
        elif kind < 0.6:
            a = f"{n}{r.choice(['', ' bis', ','])} {r.choice(['rue', 'chemin', 'impasse', 'quai'])} {r.choice(['des', 'de la', 'du', 'des Deux'])} {s}"
        elif kind < 0.78:
            a = r.choice([f"{s}{r.choice(['straße', 'weg', 'gasse', 'allee'])}", f"Am {s}en {r.choice(_STREETS)}", f"An der {s}"]) + f" {n}{r.choice(['', ' b', 'a'])}"
        elif kind < 0.9:
            a = r.choice(["C/ del", "Calle", "Avda. de los", "Plaza del", "Calle Mayor"]) + f" {s} {n}{r.choice(['', ', bajo', ', 2º B'])}"
        else:
            return r.choice(["海棠", "文明", "竹林", "建设"]) + r.choice("路街巷") + n + r.choice(["号", f"弄{r.randint(1, 60)}号", f"号{r.randint(1, 20)}栋"])
        a = r.choices([a, f"{a}, {r.choice(_TOWNS)}", f"{a}, {self.digits(5)} {r.choice(_TOWNS)}"], [4, 2, 2])[0]
        return r.choices([a, a.upper()], [5, 1])[0]

    def fill(self, s: str) -> str:
        r = self.r
        while "{" in s:
            a = s.index("{")
            b = s.index("}", a)
            k = s[a + 1 : b]
            v = {
                "n": lambda: str(r.randint(1, 10 ** r.choice([2, 3, 3, 4]) - 1)), "n4": lambda: str(r.randint(1000, 9999)), "n8": lambda: self.digits(8, "123456789"), "d": lambda: str(r.randint(0, 9)), "t": lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}", "w": lambda: r.choice(_HOSTS),
                "S": lambda: r.choice(_STREETS), "T": lambda: r.choice(_TOWNS), "I": self.id_number, "G": lambda: r.choice(_GIVEN), "F": lambda: r.choice(_STREETS), "W": lambda: r.choice(_WORDS), "O": lambda: r.choice(_NOUNS), "D": lambda: self.made(("te", "e", "en", "er", "es", "liche", "ige", "ische", "nde")), "E": lambda: self.made(("en", "ung", "ungen", "heit", "er", "el", "e", "keit", "tion", "s", "ing", "ment")),
            }[k]()
            s = s[:a] + v + s[b + 1 :]
        return s

    def text(self) -> tuple[str, set[tuple[str, int]]]:
        """One text and its true (kind, start) pairs."""
        r, truth, out = self.r, set(), ""
        make = {"email": self.email, "phone": self.phone, "id_number": self.id_number, "address": self.address, "name": self.name}
        make["han"] = lambda: r.choice(_HAN_FAMILY) + "".join(r.choice(_HAN_GIVEN) for _ in range(r.choice([1, 2, 2])))
        short = {"H": "han", "N": "name", "E": "email", "P": "phone", "A": "address", "I": "id_number"}
        for _ in range(r.randint(1, 4)):
            kind = r.choices([*KINDS, "none", "fill"], [2, 2, 2, 2, 3, 7, 3])[0]
            s = r.choice(_FILL if kind == "fill" else self.cases[kind])
            piece = ""
            while s:
                a = s.find("{")
                if a < 0:
                    piece, s = piece + s, ""
                    break
                b = s.index("}", a)
                k = s[a + 1 : b]
                piece, s = piece + s[:a], s[b + 1 :]
                if kind not in ("none", "fill") and (k == "" or k in short):
                    what = kind if k == "" else short[k]
                    value = make[what]()
                    truth.add(("name" if what == "han" else what, len(out) + len(piece)))
                    piece += value
                else:
                    piece += self.fill("{" + k + "}")
            out += piece + r.choices([" ", "\n", "\n\n"], [5, 2, 1])[0]
        if r.random() < 0.1 and "ß" not in out and "ŉ" not in out:
            up = out.upper() if r.random() < 0.5 else out.lower()
            if len(up) == len(out):
                out = up
        return out, truth


def sentences(seed: int = 11, number: int = SENTENCES, common: frozenset[str] = frozenset(), held: bool | None = None) -> tuple[list[tuple[str, set[tuple[str, int]]]], Names]:
    """Texts with their true spans, and the names taken as known; ``held`` True takes the kept-out patterns alone, False all others."""
    maker = Maker(seed, common, held)
    return [maker.text() for _ in range(number)], maker.names
