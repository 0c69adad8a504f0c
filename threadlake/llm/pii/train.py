"""Training of the model: ``python -m threadlake.llm.pii.train FOLDER``.

Labelled people (given name and surname of at most ``MAX_PEOPLE`` rows of profiles, those of lowest row_no) give the
lexicon: given names, and endings that several family names share. Labelled texts are generated: entities of every
type in several national forms, and look-alikes, are put into carrier phrases of four languages, ``SENTENCES`` in all,
from a fixed seed. The weights maximise the conditional likelihood of the labelled segmentation, with an L2 prior.
A tenth of the texts is held out; its precision and recall are printed.
"""

from __future__ import annotations

import random
import sys
from collections import Counter, defaultdict

from threadlake.llm.pii.model import SemiCrf
from threadlake.llm.pii.spans import Lexicon, candidates
from threadlake.llm.pii.view import View

MAX_PEOPLE = 5000
SENTENCES = 9000
#: An ending counts when this many family names share it.
SHARED = 3

#: Given names in common use in several languages, besides those of the labelled people.
GIVEN = "Anna Maria Peter Paul John James Robert Michael William David Thomas Daniel Matthew Anthony Steven Andrew Joseph Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Laura Emma Olivia Sophia Julia Lena Lukas Felix Jonas Max Hans Klaus Stefan Andreas Sabine Monika Ursula Heike Pierre Jean Michel Philippe Nicolas Julien Camille Chloé Léa Manon Sophie Claire Isabelle Carlos José Juan Miguel Antonio Javier Carmen Lucía Elena Marta Ana Pablo Sergio Diego".split()
#: Family names in common use, so that the model does not rest on the learned endings alone.
FAMILIES = "Smith Johnson Brown Taylor Wilson Meyer Müller Schmidt Schneider Fischer Weber Becker Martin Bernard Dubois Moreau Laurent García López Martínez Sánchez Pérez Kowalski Novak Horvat Nielsen Hansen Rossi Bianchi Silva Costa O'Brien McDonald Nguyen Patel Khan".split()
TITLES = "Mr Mrs Ms Dr. Prof. Herr Frau Mme M. Sra. Sr. Mr. Mrs. Dr".split()
PARTICLES = ["van ", "von ", "de ", "del ", "de la ", "van der "]
STREETS = "Mill Park Church Oak Garden Station Queen River Maple Bridge Linden Rosen Weaver Cedar Harbour".split()
CITIES = "Ashford Millhaven Kirchdorf Oakville Valmont Sandburg Lakemoor Berlin Lyon Madrid Boston Leeds Grünau Altstadt".split()
CARRIERS = [
    "Please ask {} about the keys", "I met {} at the station.", "{} takes over the shift", "We moved to {} last week", "Call me on {} if it is urgent.", "They asked for {} at the gate.", "{} – please do not share", "send it to {} instead", "My address is {}.", "write to {} today", "cc {} please", "HR has {} on file for me", "You can reach me at {}.",
    "Bitte an {} schicken.", "Vertretung macht {}.", "Erreichbar unter {}.", "Im Formular steht {}.", "Treffpunkt: {}", "Das Paket geht an {}.", "C'est {} qui décide.", "Mon numéro : {}.", "J'ai donné {} à la réception.", "On se retrouve au {}.", "Envoyez-le à {} svp.", "Lo lleva {} desde hoy.", "Llámame al {}.", "Les di {} en recepción.", "La cena es en {}.", "Mi correo es {}.", "declined, {} comes instead", "accepted, joining from {}", "tentative – call {}", "({})", "{}", "{} rings at the front desk", "so we can close the ticket. {} rings here", "That was the last build.\n{}", "Look at the page: {}",
]
NEUTRAL = [
    "The build is green again, {g} fixed it.", "Thanks {g}, looks good.", "Danke {g}, das passt so.", "Merci {g}, c'est parfait.", "Gracias {g}, así está bien.", "{g} is on leave tomorrow.", "Please ask {g} about the keys", "C'est {g} {i}. qui décide.", "Der Kalender wird heute geprüft.", "Seite 25 im Leitfaden ist schwer zu lesen.", "La page 12 du guide est difficile à lire.", "La página 8 se lee mal.",
    "Project {c} Bridge starts Monday.", "Room 2.31 on floor 4, Building C.", "Step 34 of the plan says to check the list first.", "{g} and {h} need it tonight.", "We go to {c} on Monday.", "Will {g} be there?", "May {g} join us?", "Lunch in {c} with {g}.",
]
THINGS = ["seq {9} was skipped.", "Meeting ID: {3} {3} {3} {2}.", "Bridge {3} {3} {2}", "Ticket INC-{3}-{2}-{4} is still open.", "key {x}-{3}-{4}.", "commit {x} fixes it.", "hash @ {x} dot release.", "retry@{2}s and backoff@{1}m.", "ping @channel and @here please.", "message 17{11} has no parent.", "Parcel tracking ZX{9}DE.", "cost centre {4} {3}.", "cost centre 00{2} {3}.", "Bridge 00{1} {3} {2}", "Meeting ID: 00{1} {3} {3} {2}.", "Der Platz {1} ist frei.", "Kein Weg {2} ist offen", "Die Straße {1} ist gesperrt", "Mein Ring {1} passt", "Auf Platz {1} liegt das Team", "Budget is {3},{3}.00 EUR for 2026.", "Build {2}.{1}.{4}.{3} is out.", "10.{2}.{2}.{1} answers again.", "from 12.03.2026 14:30 to 13.03.2026 09:15.", "Thread is 19:{x}{x}@thread.v2.", "mri 8:orgid:{x}-{4}-{4} is unknown.", "order {9} arrived", "version {9}", "{g} @ Desk {2}", "Desk 4-{3}", "Room {3}-{2}", "{g} #{5}", "row {9}", "batch {3}-{2}-{4} is done", "ref {11}", "see {9}", "ticket {3} {2} {4} is open", "serial C{2}AB{4}", "sku A{8}", "invoice {2} {3} {3} {3} is paid"]


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def fill(r: random.Random, pattern: str) -> str:
    """# a digit, A a letter, all else as it is."""
    return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHKLMNPRSTUVWXYZ") if c == "@" else c for c in pattern)


PHONES = ["+49 30 #######", "+49 (0)30 ### ## ##", "0049 40 #######", "+44 1632 9#####", "(0)1632 9# ## ##", "+33 1 ## ## ## ##", "01.##.##.##.##", "01 ## ## ## ##", "+34 9## ### ###", "+349## ######", "(2##) 555 01##", "2##-555-01##", "2##.555.01##", "2## 555 01## ext. ##", "+1 (2##) 555-01##", "+12##55501##", "+1 2## 555-01##", "030/#######", "tel:+1-2##-555-01##", "+1-2##-555-01##", "555-01## ext #", "tel 555-01##", "020 7946 0###"]
IDS = ["SSN ###-##-####", "social security number: ###.##.####", "###-##-####", "### ## ####", "SSN #########", "NI number QQ ## ## ## A", "QQ######C", "QQ######C", "QQ ## ## ## B", "Passport @#@######", "passport no. @@#######", "Reisepass @########", "Personalausweis @##@@####", "ID card @###@#####", "driver licence @####-#####-#####", "DNI ########@", "DNI ##.###.###-@", "NIE X#######@", "Steuer-ID ## ### ### ###", "Steuer-ID: ###########", "n° de sécurité sociale 1 ## 0# ## ### ### ##", "passeport ##@@#####"]


#: Parts that made-up names of people outside the lexicon are built from.
SYLLABLES = "ba be bo da de di do fa ga ge go ha hi ji ka ke ki ko la le li lo ma me mi mo mu na ne ni no nu pa pe ra re ri ro sa se shi so su ta te ti to tsu va vi wa ya yo yu za zi zo".split()
ENDS = "n r s l m k t nd ng sh th".split()
#: Things and places that are named with capitals, in which {u} is a word of any kind and {g} a given name.
NOT_PEOPLE = "{g} {u} Institute|{g} {u} University|{u} {u} Street|{u} Park|{g} Park|{g} Garden Street|{u} Garden|{u} Falls|{u} Street|{u} Hill|San {g}|San {g} Hill|Santa {g}|Mount {u}|Lake {u}|{u} Valley|Port {u}|{u} Tower|{u} Bridge|Hotel {u}|{u} Museum|Projekt {u}|{u} Platz|Villa {u}|{u} River|The {u}|New {u}|Universität {u}|Rue {u}|Plaza {u}|{u} Group|{u} Team|{u} Teams|{u} Cloud|{u} Studio|United States|{u} Chrome|Team {u}|Project {u}|{u} Release".split("|")
AROUND = ["the {} release name is a joke.", "{} release, train 5{2}.", "We walked past {} on Monday.", "The {} opens at nine.", "{} opens in May.", "Lunch is at {} today.", "Das {} ist geschlossen.", "Treffpunkt ist {}.", "The meeting is at {}.", "{} was crowded again.", "La réunion est à {}.", "Nos vemos en {}.", "The {} plan needs a review", "{} build is green"]


class Maker:
    def __init__(self, given: list[str], families: list[str], seed: int = 1):
        self.r, self.given, self.families = random.Random(seed), given, families

    def unknown(self) -> str:
        """A word with a capital that no lexicon holds."""
        word = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(2, 3))) + (self.r.choice(ENDS) if self.r.random() < 0.4 else "")
        return word.capitalize()

    def thing(self) -> str:
        r = self.r
        value = r.choice(NOT_PEOPLE)
        while "{u}" in value:
            value = value.replace("{u}", r.choice([self.unknown(), r.choice(STREETS), r.choice("Amber Silver Olive Copper Northern Golden Hidden Marble".split())]), 1)
        return r.choice(AROUND).replace("{2}", digits(r, 1)).replace("{}", value.replace("{g}", r.choice(self.given)))

    def email(self) -> str:
        r = self.r
        local = r.choice(["anna.meyer", "b.kowalski", "o'neil", "sales+eu", "lee_k", "maria-lopez", "tom84"])
        host = r.choice(["example.org", "mail.acme.co.example", "firma.test", "corp-works.test", "news.invalid", "company.com", "uni.edu"])
        form = r.choice(["{l}@{h}"] * 4 + ["{l} @ {h}", "{l}(at){h}", "{l} (at) {h}", "{l}[at]{h}", "{l} at {d}", "{l} [at] {d}", "{l} AT {b}", "<{l}@{h}>", "{l}(at){b}"])
        return form.format(l=local, h=host, d=host.replace(".", " dot "), b=host.replace(".", "[.]")).strip("<>")

    def name(self) -> str:
        r = self.r
        g, p = r.choice(self.given), r.choice(PARTICLES)
        f = r.choice(self.families if r.random() < 0.6 else FAMILIES)
        f2 = r.choice(self.families)
        if r.random() < 0.3:  # nobody the lexicon knows
            g, f, f2 = (self.unknown() for _ in range(3))
            return r.choice([f"{g} {f}"] * 5 + [f"{g} {p}{f}", f"{g} {f}-{f2}", f"{f.upper()}, {g}", f"{r.choice(TITLES)} {g} {f}", f"{r.choice(TITLES)} {f}", f"{g} {f} {f2}", f"{r.choice('ABLMRT')}. {f}"])
        return r.choice([f"{g} {f}"] * 5 + [f"{f}, {g}", f"{g} {r.choice(self.given)} {f}", f"{g} {r.choice('ABLMRT')}. {f}", f"{r.choice('ABLMRT')}. {f}", f"{r.choice(TITLES)} {f}", f"{r.choice(TITLES)} {g} {f}", f"{f.upper()}, {g}", f"{g} {p}{f}", f"{g} {f}-{f2}"])

    def address(self) -> str:
        r = self.r
        s, c, n, z = r.choice(STREETS), r.choice(CITIES), r.randint(1, 250), digits(r, 5)
        return r.choice([f"{n} {s} Street, {c}", f"{n}-{n + 2} {s} Avenue, {c}", f"Flat 4, {n} {s} Lane, {c}", f"{n} {s} Rd, Apt 5, {c} {z}", f"{n} {s.upper()} ST, {c.upper()}", f"{s}straße {n}, {z} {c}", f"{s}weg {n}b in {z} {c}", f"{s}platz {n}, {c}", f"{s}str. {n}", f"Am {s}en Markt {n}", f"{s} {r.choice('Anna Clara Theresia'.split())} Platz {n}", f"{n} {s} Mews, {c}", f"{n} {s} {r.choice('Mews Street Lane Road Close'.split())}", f"{n}, avenue {s}, {c}", f"{n} bis, rue du {s}, {z} {c}", f"calle {s} {n}, 3º B, {z} {c}", f"C/ {s}, {n} - {c}", f"P.O. Box {n}, {c} {z}", f"Postfach {n}"])

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text of one to four sentences and its true spans."""
        r, out, gold = self.r, "", []
        for _ in range(r.randint(1, 4)):
            out += " " if out else ""
            if r.random() < 0.5:
                kind = r.choice(["email", "phone", "id_number", "address", "name", "name"])
                value = {"email": self.email, "name": self.name, "address": self.address, "phone": lambda: fill(r, r.choice(PHONES)), "id_number": lambda: fill(r, r.choice(IDS))}[kind]()
                carrier = r.choice(CARRIERS)
                if kind == "name" and r.random() < 0.2:
                    carrier = "\x02{}\x03 can you check this?"
                left, right = carrier.split("{}")
                start = len(out) + len(left)
                skip = 0
                if kind == "id_number":  # the number is the entity, the label before it stays readable
                    while skip < len(value) and not (any(c.isdigit() for c in value[skip:].split(" ")[0]) or value[skip:].startswith("QQ ")):
                        skip += len(value[skip:].split(" ")[0]) + 1
                gold.append((start + skip, start + len(value), kind))
                out += left + value + right
            elif r.random() < 0.35:
                out += self.thing()
            elif r.random() < 0.5:
                t = r.choice(NEUTRAL)
                out += t.format(g=r.choice(self.given), h=r.choice(self.given), c=r.choice(CITIES), i=r.choice("ABLMRT"))
            else:
                t = r.choice(THINGS).replace("{x}", f"{r.getrandbits(40):010x}").replace("{g}", r.choice(self.given))
                for n in range(1, 12):
                    while f"{{{n}}}" in t:
                        t = t.replace(f"{{{n}}}", digits(r, n), 1)
                out += t
        return out, gold


def people(folder: str) -> tuple[list[str], list[str]]:
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{folder}/profiles.parquet", columns=["row_no", "given_name", "surname"]).sort_by("row_no").slice(0, MAX_PEOPLE).to_pylist()
    known = [r for r in rows if r["given_name"] and r["surname"] and "@" not in r["given_name"]]
    return sorted({r["given_name"] for r in known}), sorted({r["surname"] for r in known})


def train(folder: str, rounds: int = 12, rate: float = 0.3, prior: float = 0.002) -> SemiCrf:
    given, families = people(folder)
    shared = Counter(f.lower()[-5:] for f in families if len(f) > 5)
    endings = frozenset(e for e, n in shared.items() if n >= SHARED)
    lexicon = Lexicon(frozenset(given) | frozenset(GIVEN), endings)
    maker = Maker(sorted(lexicon.given), families)
    data = []
    for _ in range(SENTENCES):
        text, gold = maker.text()
        found = candidates(text, lexicon, frozenset(("email", "phone", "id_number", "address", "name")))
        # A candidate is true where it has a true span's type and bounds; addresses and names with most of the span count too.
        true = []
        for s, e, k in gold:
            near = [c for c in found if c.kind == k and c.start < e and c.end > s]
            if near:
                true.append(min(near, key=lambda c: (abs(c.start - s) + abs(c.end - e), c.start)))
        data.append((sorted(set(found)), sorted(set(true)), gold, text))
    cut = len(data) * 9 // 10
    model = SemiCrf({}, lexicon)
    step: dict[str, float] = defaultdict(float)
    order = list(range(cut))
    for _ in range(rounds):
        random.Random(7).shuffle(order)
        for i in order:
            found, true, _, _ = data[i]
            if not found:
                continue
            _, expected = model.expected(found)
            observed = model.observed(true)
            for f in expected.keys() | observed.keys():
                g = observed.get(f, 0.0) - expected.get(f, 0.0) - prior * model.weights.get(f, 0.0)
                step[f] += g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / (1e-6 + step[f]) ** 0.5
    hits = made = wanted = 0
    for _, _, gold, text in data[cut:]:
        got = model.find(text)
        want = {(k, s) for s, e, k in gold}
        near = {(c.kind, s) for c in got for s, e, k in gold if k == c.kind and c.start < e and c.end > s}
        hits, made, wanted = hits + len(near & want), made + len(got), wanted + len(want)
    print(f"held out: precision {hits / made:.4f}, recall {hits / wanted:.4f}, {wanted} spans")
    _strangers(model)
    return model


#: People of many countries whose names no lexicon here holds, to measure on.
STRANGERS = "Tendai Mukwashi|Kwabena Asante-Mensah|Xiuying Zhang|Babajide Adeyemi|Ngozi Okonjo|Chukwuemeka Obi|Aoife Brennan|Yuki Tanaka|Haruto Watanabe|Min-jun Park-Lee|Siddharth Iyer|Lakshmi Raman|Thandiwe Dlamini|Olumide Bakare|Fatima Zahra Benali|Yusuf Demirel|Aylin Kaplan|Dmitri Sokolov|Oksana Shevchenko|Zsofia Nagy|Bence Kovacs|Eirik Solbakken|Astrid Lindqvist|Aino Virtanen|Giedrius Petrauskas|Catalina Restrepo|Thiago Nogueira|Beatriz Carvalho|Nguyen Thi Lan|Siti Rahmawati|Agus Santoso|Mele Tupou|Keanu Kahale|Wiremu Parata|Aroha Ngata|Amina Diallo|Moussa Traore|Abebe Bikila|Selam Tesfaye|Ravshan Karimov".split("|")
CONTEXTS = ["Please ask {} about the keys.", "{} joined the call late.", "I met {} at the station.", "Bitte an {} schicken.", "C'est {} qui décide.", "Lo lleva {} desde hoy.", "cc {} please", "Thanks to {} for the slides.", "Signed: {}", "{} will present first.", "Yesterday {} broke the build again.", "Hier, {} a cassé la version.", "Ayer {} rompió la versión.", "Mr. {} called.", "\x02{}\x03 can you check?"]


def _strangers(model: SemiCrf) -> None:
    """How many names of strangers are found, and found whole, in contexts other than those of training."""
    found = whole = 0
    for n in STRANGERS:
        for c in CONTEXTS:
            text = c.format(n)
            at = text.index(n)
            near = [s for s in model.find(text) if s.kind == "name" and s.start < at + len(n) and s.end > at]
            found += bool(near)
            whole += any(s.start <= at and s.end >= at + len(n) for s in near)
    print(f"strangers: found {found / len(STRANGERS) / len(CONTEXTS):.4f}, whole {whole / len(STRANGERS) / len(CONTEXTS):.4f}")


if __name__ == "__main__":
    assert View  # the view of a generated text is the text
    train(sys.argv[1]).save()
