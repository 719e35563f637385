"""The small labelled table for problem 3: sentence frames with slots, filled from a seeded generator.

Frames are everyday sentences of offices, shops, clinics and projects in four languages, and unlabelled ones with numbers, codes,
versions, places and names of things. A slot in braces stands for a span of the kind that it names (name, email, phone,
identity, address) or for unlabelled filler: w a made-up word, W one with a capital, g a lone given name, n, a and v ordinary words
(drawn from the vocabulary file of a public tokenizer, if there is one), t a ticket, d a date, num a number, proj the name of a thing,
label the label of an identity number, town a town. All values are invented.
"""

from __future__ import annotations

import base64
import os
import random
import re
from functools import lru_cache

from memlake.llm.names import GIVEN, SHORT

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

LABELLED = """
You can write to {email} at any time.
My address for the {n} list is {email} now.
{email} bounced twice, please check the {n}.
Forward the {a} file to {email}, then call {g}.
From: {email}
To: {email}, {email}
E-mail: {email}
Kontakt: {email} oder {phone}
Mail bitte an {email}, danke.
Envíe la factura a {email} antes del viernes.
Merci d'envoyer le devis à {email} ({w}).
Questions about {w}? Ask {email}.
The account {email} was locked on {d}.
({email}) asked for a {n}.
Add {email} to the {w} channel and remove {email}.
<{email}> joined the call
{g} ({email}) will {v} the {n}.
Support answers under {email} or in {t}.
Best reached by mail, {email}, or by phone, {phone}.
Unsubscribe {email} from the {a} digest.
Phone: {phone}
Fax {phone}, mobile {phone}
Ring {phone} if the {n} does not open.
You may dial {phone} after six.
The desk at {w} can be called on {phone}.
Reception ({phone}) closes at noon.
Please text {g} on {phone} about the {n}.
Bitte unter {phone} zurückrufen.
Tel. {phone}, werktags bis {num2} Uhr
Ruf mich an: {phone}
Appelez le {phone} pour {w}.
Téléphone : {phone}, demander {g}
Llame al {phone} y pregunte por {g}.
Teléfono de guardia: {phone}
Emergency number {phone}; ticket {t}.
His number changed from {phone} to {phone}.
WhatsApp {phone} works best for {w}.
The pager of the {n} crew is {phone}.
Voicemail left at {phone} on {d}
{phone} is the direct line of {name}.
The {label} is {identity}.
{label}: {identity}
{label} no. {identity} has expired.
{label} number {identity} was typed in by {g}.
Never store a {label} such as {identity} in {w}.
Customer showed {label} {identity} at the desk.
Delete {label} {identity} from the {n} today.
Found {identity} ({label}) inside the {a} backup.
Ihre {label} lautet {identity}.
{label} {identity} liegt dem Antrag bei.
Numéro {label} {identity} reçu le {d}.
El {label} {identity} figura en la {n}.
Form {num2}: {label} {identity}, town {town}
The {label} ending the form was {identity}, please redact it.
{name}, {label} {identity}, called about {t}.
Applicant: {name}; {label}: {identity}; phone: {phone}
The parcel goes to {address}.
Delivery address: {address}, {num5} {town}
We moved from {address} to {address}.
Their office stands at {address}, {town}.
Meet me outside {address} at {num2} o'clock.
Invoice to {address}, {town}, not to {w}.
Lieferung an {address}, {num5} {town}, bitte klingeln.
Die Werkstatt liegt in {town}, {address}.
Adresse : {address}, {num5} {town}
Le dépôt est au {address} à {town}.
La tienda está en {address}, {town}.
Enviar a {address}, {num5} {town}.
The van waited at {address} until the {n} arrived.
Keys for {address} are with {name}.
{name} lives at {address} and works on {w}.
Site visit at {address} on {d}, ask for {g}.
House: {address}
The fire started near {address} last night.
{name} will be there.
{name} called.
{name} flew in from {town}.
{name} paid for the {n} in {town}.
{name} left early on {d}.
{name} opened the {n} and went home.
{name} arrived with {name} from {town}.
{name} runs the {n} at {w}.
I met {name} in {town} last week.
Thanks to {name} and {name} for the {a} {n}.
The report by {name} was {a}.
Asked {name} whether {w} still needs a {n}.
Meeting with {name} moved to {d}.
Attendees: {name}, {name}, {name}
Author: {name}
Reviewer {name} wants another {n}.
According to {name}, the {n} was {a}.
{name} said that {w} is {a} and left.
We owe {name} an answer about {t}.
Please introduce me to {name} from {w}.
{name}'s laptop runs {w} {num1}.{num2}.
{name}’s idea was to {v} the {n}.
Mr. {name} and Mrs. {name} signed the {n}.
Dr. {name} saw the patient on {d}.
Prof. {name} teaches {n} in {town}.
Herr {name} hat {w} bestellt.
Frau {name} ruft morgen zurück.
Mit {name} über {w} gesprochen.
Laut {name} ist der Vertrag unterschrieben.
Vertretung für {name}: {name}
{name} hat den Schlüssel.
Mme {name} arrive demain.
Selon {name}, le projet {w} avance bien.
Le dossier de {name} est complet.
{name} a signé le contrat hier.
La señora {name} vendrá el lunes.
Hablé con {name} sobre {w}.
{name} firmó el contrato en {town}.
El informe de {name} llegó tarde.
Employee {name} ({email}) left on {d}.
Patient {name}, born {d}, phone {phone}
assigned to {name} since {d}
cc {name}, {email}
- {name}: {v} the {n}
Signed, {name}
owner {name}, backup {name}
ask {name} or {g} for the {n}
the keys were given to {name}, who {v} the {n}
Why did {name} {v} {w}?
Nobody but {name} can {v} the {n} before {d}.
Since {name} left, {w} has been {a}.
{name} from {town} won the {n}.
Talked to {name} today about {t} and {w}.
Per {name}, {w} stays {a}.
Contract between {proj} and {name} of {town}
Batch {num4} of 0{num3} aborted at 03:{num2}:{num2}.
Loss {num1}.{num5} after epoch {num3}, rate {num1}.{num3}, seed {num10}.
Release 20{num2}.{num1}.{num2}, patch {num1}.{num3}.{num2}.
Release {num4}.{num2}.1, image {num1}.{num3}.{num2}.{num4} is out.
Span {hex}-{num4}-{hex} took {num3} ms.
Request {hex}{num2}-{num4}-{num3}{hex} failed with code {num3}.
Process {d}-{num4}-{num2} stopped on host 10.{num2}.{num1}.{num2}.
Order {num4}-{num3}-{num4} totals {num1},{num3}.{num2} euros.
Moved {num3} {num2} {num4} rows into {w}.
Invoice {num8} was paid, receipt {num4}/{num4}.
Commit {hex} changes {num3} lines.
Port {num4}, timeout {num5} ms, retries {num1}.
Tickets {t} and {t} are done, {t} is open.
Position {num2}.{num6}, {num2}.{num6} on the map
Barcode {num13}, shelf {num3}-{num2}
Temperature fell from {num2}.{num1} to {num1}.{num2}.
Serial {hex}, firmware {num1}.{num2}.{num3}
On {d} at {num2}:{num2} we {v} {num4} files.
Hall {W} and room {W} are free on {d}.
Conference room {cap} seats {num2}.
The {cap} Street market opens at {num1}, a {a} place.
We left {town} for {town} on {d}.
{g} and {g} share a desk.
{g} likes the {a} {n}.
{g} thinks that {w} should {v} the {n}.
Tell {g} that {w} is {a}.
I told {g} about {t} on Monday.
{g} hat {w} schon geprüft.
{g} a fermé {w} hier soir.
{g} cerró {w} el martes.
Selon {g}, {w} marche.
Laut {g} fehlt noch {w}.
Según {g}, falta {w}.
{g} at the {proj} desk dot com style
The {proj} team meets {proj} on Friday.
{proj} replaced {proj}.
We sold {proj} to a {n} in {town}.
{proj} is {a}.
Ask the {proj} group for a {n}.
{proj}, {proj} and {w} are {n} projects.
@{w}/{w}@{num1}.{num2}.{num1} needs @{w}/core
npm install {w}@{num1}.{num2} and {w}
see docs at {w}.{w} or {w}/{w}
The {n} {v} a {a} {n}.
{cap} {n} and {a} {n} are {a}.
{cap} {cap} is a {a} {n}.
{W} {v} {num2} {n}, and {w} {num4}.
Der Bericht über {w} liegt im Ordner {W}.
Die neue Version {num1}.{num2} von {w} läuft seit {d}.
Wir haben die Daten von {w} nach {w} kopiert.
Bitte den Server {w} erst am Freitag neu starten.
La versión {num1}.{num2} de {w} falla desde {d}.
Il faut relancer {w} avant la réunion du {d}.
Le rapport {t} parle de {w} et de {w}.
Hay que revisar {w} antes de {t}.
Todo: {v} {w}, {v} {w}, then {v} the {n}.
{n}, {n} and {n}: {a}
{cap} Manager, {cap} Office, {town}
Monday Tuesday Wednesday {d}
Version {num1} of {w} runs on {cap} Linux.
If {w} is {a}, {v} {w} and wait for {t}.
Nobody can {v} {w} because the {n} is {a}.
Why is {w} {a}? Because {w} {v} the {n}.
{W} needs {num2} {n}; {w} needs {num3}.
Yesterday {w} was {a}, today {w} is {a}.
Good Morning All, the {n} is {a}.
Re: {n} for {W}
New {cap} Policy for {cap} Staff in {town}
Both {W} and {w} {v} the {a} {n}.
{W} {v} {w} at noon.
{cap} wants to {v} {w} before {t}.
Version {num1}.{num2}.{num2} of {w} {v} a {n}; {w} comes later.
Version {num1}.{num2}.{num1} brings a {n}.
{W} {num1}.{num2}.{num2} cannot {v} a {a} {n}.
{W} {num2}.{num1}.{num2} was {a}, {w} {num1}.{num1}.{num2} is not.
Upgrade {w} from {num1}.{num2}.{num1} to {num1}.{num2}.{num2} on {d}.
La version {num1}.{num2}.{num2} de {w} est {a}.
Die Version {num1}.{num2}.{num1} von {w} ist da, {g} weiß es.
The number of {n} in {w} rose from {num3} to {num2}, mainly because of {w}.
Sales went from {num4} to {num2}, thanks to {g}.
Between {num2} and {num3} {n} are {a}; {num2}, in fact.
Out of {num4}, only {num2}, mostly {a} ones, were {a}.
{num4} {n} in {w} and {num2} in {w} took {num2} ms and {num4} ms.
Skipped {num4} {num2} {num4} while reading {w}.
Removed {num3} {num2} {num4} from the {n}, the rest stays.
Removed {num4} {num2} {num4} from {w}, kept {w}.
Line {num3} of {num6} is empty; next try at {num2}:{num2}:{num2}.
Score {num1}.{num4} against {num1}.{num6}, run {num12}.
Page {num2} of {num3}, figure {num1}.{num2}
Voucher {num4}-{num3}-{num4} pays {num3}.{num2} of {num1},{num3}.{num2}.
Tag {num4}.{num2}.{num1}, image {num1}.{num3}.{num2}.{num3}
Span {hex}{num2}-{num4}-{num2}{hex}{num2} holds {num4} {n}.
Task {d}-0{num2}-{num2} ended on node {num2}.{num2}.{num1}.{num2} with {num3}.
{g} moved {w} to {w} on {d}.
{g} and {w} agree; {g} {v} the {n} on Friday.
{g} a testé {w} et {w} vendredi.
{g} hat {w} auf {w} umgezogen, {t} ist zu.
{g} pidió {w} a {w}.
Keep {w} for {a} work and give {w} to the {n} team. <!-- kind: note tags: {n},{w} -->
Keep {w} as it is. [more: {w}]
Branch {w}/{w}-{num3} is {a} because {t} stays open.
The {n} at {w} dot com is {a} at {num2} percent.
Mail for {email} came back, try {w}.
Messages for {email} go to {g}.
The {n} went to {email}, not to {g}.
The supplier of {w} is at {phone}, afternoons only.
{g} gave {phone} as the {n} number for {w}.
From Monday the hotline is {phone} instead of {phone}.
Dial {phone} for the {n} round.
The {n} used {label} {identity}.
{g} sent the {label} ({identity}) for {t}.
The driver stopped at {address}; the {n} paid.
{g} has a flat at {address} and a {n} there.
The party is at {address} in {town} on {d}.
{name} and {g} {v} the {n}.
Notes by {name}, {n} team
Approved by {name} for {t}.
Speak to {name} about {w}.
With {name} on the {n} until {d}.
{name} keeps {w} until {d}.
{name} read the {n} of {w}.
{name}'s {n} about the {a} {n} is in {t}.
{proj} and {proj} {v} one {n}.
{g} sits at the {proj} desk.
{proj} and {proj} are {a} this week.
{g} joined {proj} on {d}.
Neues Büro: {address}, {town}, ab {d}.
Nuestro local: {address}, {town}, desde {d}.
Nouveau siège : {address}, {town}, dès le {d}.
Der Speicher ist voll, und der Dienst {w} braucht mehr Platz als {w}.
Die Anzeige der Minuten in {w} fehlt noch, bevor {w} startet.
Laut {g} war die Sitzung zu lang und die Liste zu kurz.
Bis {d} bleibt der Zugang zu {w} gesperrt, danach gilt die neue Regel.
Der Antrag für {t} liegt im Schrank, seit dem {d} fehlt die Kopie.
Seit {d} hat der Laden weniger Kunden als {w}.
{g} hat den Termin mit {w} auf Montag verschoben.
Depuis le {d}, la liste de {w} est trop longue.
Desde el {d} la tienda cierra antes que {w}.
{g} typed the {label} {identity} into the {n}.
Never print the {label} no. {identity} in {w}.
{label} no. {identity} is in {w} and in {w}.
Someone left {label} {identity} in {w}, remove it.
No {label} no. {identity} in the {n}, please.
A {label} number ({identity}) in {w} is not {a}.
""".strip().split("\n")

#: Ordinary words where no vocabulary file is at hand.
ORDINARY = "table window paper garden river button folder market kitchen letter season corner bottle carpet engine ladder mirror pocket saddle ticket".split()
TOWNS = "Grenholm Asterby Wolvenau Pontrelle Carradale Millhaven Nordhagen Bellacosta Tarnbrück Vauclair".split()
LABELS = [
    "tax id", "tax number", "passport", "passport number", "national id", "national insurance number", "social security number", "SSN", "NI number", "NINO", "TIN", "VAT id",
    "Steuer-ID", "Steuernummer", "Ausweisnummer", "Reisepass", "DNI", "NIE", "pasaporte", "passeport", "numéro fiscal", "sécurité sociale", "identity number", "ID card", "identity card",
]
STREETS = "Street St St. St. Ln. Rd. Road Rd Avenue Ave Lane Close Way Drive Blvd Boulevard Court Terrace Place Square Crescent Row".split()
ACCENTED = {"jose": "José", "zoe": "Zoë", "soren": "Søren", "jurgen": "Jürgen", "renee": "Renée"}


@lru_cache(maxsize=1)
def lexicon() -> tuple[frozenset[str], frozenset[str]]:
    """Words of the public vocabulary that stand in lower case, and those that stand with a capital only."""
    if not os.path.exists(VOCABULARY):
        return frozenset(ORDINARY), frozenset(TOWNS)
    with open(VOCABULARY, "rb") as lines:
        tokens = (base64.b64decode(line.split()[0]) for line in lines)
        words = {t[1:].decode("ascii") for t in tokens if re.fullmatch(rb" [A-Za-z][a-z]{2,}", t)}
    lower = frozenset(w for w in words if w.islower())
    return lower, frozenset(w for w in words if w[0].isupper() and w.lower() not in lower)


class Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.givens = sorted(GIVEN) + [s for _, xs in SHORT for s in xs.split()]
        self.lower, self.capital = (sorted(w for w in words if len(w) >= 4) for words in lexicon())

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self, least: int = 2, most: int = 4) -> str:
        onset = "b c ch d f g h j k l m n p qu r s sh t v w y z bl br cl dr fl fr gr kl kr pl pr sk sl sp st str sw th tr vr".split()
        end = ["", "", "", "l", "n", "r", "s", "x", "m", "nd", "rn", "ss", "ck", "t", "ng"]
        vowel = ["a", "e", "i", "o", "u", "a", "e", "i", "o", "u", "ai", "ea", "ou", "ie"]
        return "".join(self.r.choice(onset) + self.r.choice(vowel) for _ in range(self.r.randint(least, most))) + self.r.choice(end)

    def given(self) -> str:
        g = self.r.choice(self.givens)
        return ACCENTED.get(g, g.capitalize())

    def family(self) -> str:
        x = self.r.random()
        f = self.word(2, 4).capitalize() if x < 0.76 else self.r.choice(self.capital) if x < 0.94 else self.r.choice(self.lower).capitalize()
        if self.r.random() < 0.06:
            f = f.replace("a", "ä", 1).replace("o", "ö", 1).replace("e", "é", 1)
        if self.r.random() < 0.13:
            f += "-" + self.word(2, 3).capitalize()
        if self.r.random() < 0.1:
            f = self.r.choice(["van", "de", "da", "von", "von der", "van den", "di", "del", "de la"]) + " " + f
        return f

    def fill(self, slot: str) -> str:
        r = self.r
        if slot == "w":
            return self.word()
        if slot == "W":
            return self.word().capitalize()
        if slot == "g":
            return self.given() if r.random() < 0.8 else self.word(2, 3).capitalize()
        if slot == "t":
            return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.choice([2, 2, 3, 4]))) + "-" + self.digits(r.choice([3, 4, 5, 5]))
        if slot in ("n", "a", "v"):
            return r.choice(self.lower)
        if slot == "cap":
            return r.choice(self.lower).capitalize()
        if slot == "d":
            return f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
        if slot.startswith("num"):
            return self.digits(int(slot[3:]))
        if slot == "hex":
            return "".join(r.choice("0123456789abcdef") for _ in range(r.randint(7, 11)))
        if slot == "proj":
            first = r.choice(self.lower).capitalize() if r.random() < 0.6 else self.word(2, 3).capitalize()
            return f"{first} {r.choice(self.lower).capitalize() if r.random() < 0.8 else r.choice(self.capital)}"
        if slot == "label":
            return r.choice(LABELS)
        if slot == "town":
            return r.choice(TOWNS) if r.random() < 0.4 else self.word(2, 3).capitalize()
        return getattr(self, slot)()

    def name(self) -> str:
        x = self.r.random()
        g = self.given() if x < 0.62 else self.word(2, 3).capitalize() if x < 0.88 else self.r.choice(self.capital)
        f, m = self.family(), self.r.choice("ABCDEFGHJKLMNPRST")
        kind = self.r.random()
        if kind < 0.42:
            out = f"{g} {f}"
        elif kind < 0.60:
            out = f"{f}, {g}"
        elif kind < 0.74:
            out = f"{g[0]}. {f}"
        elif kind < 0.84:
            out = f"{g} {m}. {f}"
        elif kind < 0.88:
            out = f"{f}, {g[0]}"
        elif kind < 0.92:
            out = f"{f} {self.given()}"
        elif kind < 0.94:
            out = f"{g[0]}. {m}. {f}"
        else:
            return f"{g} {f}".upper()
        return out

    def email(self) -> str:
        r = self.r
        g, f = self.given().lower(), self.word(2, 4)
        g = g.encode("ascii", "ignore").decode() or "jo"
        w = r.choice(self.lower)
        local = r.choice([f"{g}.{f}", f"{g[0]}.{f}", f"{g[0]}{f}", f"{f}-{g[0]}", f"{f}_{self.digits(2)}", f"{g}+{w}", f"{w}{self.digits(2)}", w, f"{g}_{f}", f"{f}.{g[0]}.{f[:3]}"])
        host = r.choice([self.word(), self.word(), self.word() + "-" + w, w, r.choice(["mail.", "post.", "mx."]) + self.word()])
        tail = r.choice(["test", "invalid", "example", "co.example", "example", "com", "org", "net", "de", "fr", "es", "co.uk", "io", "edu"])
        kind = r.random()
        if kind < 0.72:
            out = f"{local}@{host}.{tail}"
        elif kind < 0.80:
            out = f"{local} at " + f"{host}.{tail}".replace(".", " dot ")
        else:
            a, b, space = r.choice("[("), "", r.choice(["", " "])
            b = "]" if a == "[" else ")"
            dots = f"{space}{a}dot{b}{space}" if r.random() < 0.6 else "."
            out = f"{local}{space}{a}at{b}{space}" + f"{host}.{tail}".replace(".", dots)
        return out.upper() if r.random() < 0.1 else out.title() if r.random() < 0.05 else out

    def groups(self, total: int, separator: str, sizes: tuple[int, ...]) -> str:
        out = []
        while total:
            size = min(total, self.r.choice(sizes))
            size = total if total - size == 1 else size
            out.append(self.digits(size))
            total -= size
        return separator.join(out)

    def phone(self) -> str:
        """An international or national number: code, area code with or without brackets, and groups of digits."""
        r, d = self.r, self.digits
        sep = r.choice([" ", " ", " ", "-", ".", "‑"])
        area = d(r.choice([2, 3, 3, 4]))
        kind = r.random()
        if kind < 0.4:
            code = r.choice(["+", "+", "+", "00"]) + r.choice(["1", "44", "49", "33", "34", "61", d(2), "3" + d(2)])
            zero = r.choice(["", "", "", "(0)"])
            rest = self.groups(r.choice([5, 6, 7, 7, 8]), sep, (2, 3, 3, 4))
            out = code + (sep if r.random() < 0.85 else "") + zero + r.choice([area, area, f"({area})" if not zero else area]) + r.choice([sep, sep, sep, ""]) + rest
        elif kind < 0.6:
            out = r.choice([f"({d(3)}) ", f"({d(3)})", f"1-{d(3)}-", f"1 {d(3)} ", d(3) + sep]) + d(3) + r.choice(["-", "-", sep]) + d(4)
        elif kind < 0.65:
            out = r.choice([f"+{d(2)}{d(10)}", f"+{d(2)}{d(9)}", f"00{d(2)} {d(2)} {d(8)}"])
        elif kind < 0.75:
            out = sep.join([f"0{d(1)}", d(2), d(2), d(2), d(2)]) if r.random() < 0.6 else sep.join(["9" + d(2), d(3), d(3)])
        else:
            lead = r.choice([f"0{area}", f"0{area}", f"(0{area})", f"0{d(4)}"])
            after = r.choice([sep, sep, "/", " "])
            out = lead + after + self.groups(r.choice([5, 6, 6, 7, 8]), r.choice([sep, sep, ""]), (2, 2, 3, 3, 4))
        return out + r.choice(["", "", "", "", "", "", f" ext. {d(r.choice([2, 3, 4]))}", f" x{d(3)}", f" ext {d(2)}", f" extension {d(3)}"])

    def identity(self) -> str:
        """Digits with or without letters before and after, in one or several groups."""
        r, d = self.r, self.digits
        a = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        sep = r.choice([" ", "-", "-", "."])
        x = r.random()
        if x < 0.3:
            return r.choice([sep.join([d(3), d(2), d(4)]), sep.join([d(2), d(7)]), sep.join([d(2), d(3), d(3), d(3)]), sep.join([d(6), d(4)]), sep.join([d(3), d(3), d(3)]), f"{d(2)}/{d(3)}/{d(5)}"])
        if x < 0.45:
            return f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}" if r.random() < 0.6 else f"{a(2)}{d(6)}{a(1)}"
        if x < 0.7:
            return a(r.choice([1, 1, 2])) + d(r.choice([6, 7, 7, 8, 9]))
        if x < 0.82:
            return d(r.choice([7, 8, 8])) + r.choice(["-", "", " "]) + a(1)
        return d(r.choice([8, 9, 10, 11, 11, 12]))

    def address(self) -> str:
        r = self.r
        house = self.digits(r.choice([1, 2, 2, 3])).lstrip("0") or "7"
        house += r.choice(["", "", "", "", "a", "b", "C"])
        s = r.choice([self.word(2, 4), self.word(2, 3), r.choice(self.lower), r.choice(self.lower), r.choice(self.capital).lower()]).capitalize()
        kind = r.random()
        if kind < 0.5:
            out = f"{house} {r.choice([''] * 9 + ['N. ', 'W. ', 'E. ', 'S. ', 'East ', 'West ', 'North ', 'South ', 'Upper '])}{s} {r.choice(STREETS)}"
            return out.lower() if r.random() < 0.08 else out
        if kind < 0.66:
            return f"{s}{r.choice(['straße', 'str.', 'weg', 'gasse', 'platz', 'allee', 'strasse', 'ring', 'ufer'])} {house}"
        if kind < 0.82:
            way = r.choice(["rue", "rue du", "rue de la", "rue des", "avenue de", "avenue", "place", "boulevard", "chemin de"])
            return f"{house}{r.choice([',', ',', ''])} {way} {s}"
        way = r.choice(["Calle", "Avenida", "C/", "Plaza", "Paseo", "Calle de", "Calle del", "Avenida de la", "Paseo de"])
        return f"{way} {s}{r.choice([',', ',', ''])} {house}"


LABELS_OF = {"name": "name", "email": "email", "phone": "phone", "identity": "identity_number", "address": "address"}


def labelled_table(copies: int = 9, seed: int = 7, frames: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one to four filled sentences with their spans (start, end, kind)."""
    frames = frames or LABELLED
    filler, r = Filler(seed), random.Random(seed + 1)
    entity = [s for s in frames if any("{" + k + "}" in s for k in LABELS_OF)]
    picks = entity * copies * 2 + [s for s in frames if s not in entity] * copies * 2
    r.shuffle(picks)
    table = []
    noise = ["(roughly)", "maybe", "soon", "too", "still", "(again)", "(est.)", "(ca.)", "(tbc)", "[sic]", "(incl.)", "(etc.)", *filler.lower[::400]]
    while picks:
        join = r.choice([" ", " ", " ", "\n- ", "\n"])
        text, spans = "", []
        for sentence in [picks.pop() for _ in range(min(len(picks), r.randint(1, 4)))]:
            if text:
                text += join
            if r.random() < 0.12:  # a word put in or lost between two others
                words = sentence.split(" ")
                k = r.randrange(len(words))
                if r.random() < 0.3 and "{" not in words[k] and "}" not in words[k]:
                    del words[k]
                else:
                    words.insert(k, r.choice(noise))
                sentence = " ".join(words)
            at = 0
            while (open_at := sentence.find("{", at)) >= 0:
                close = sentence.index("}", open_at)
                text += sentence[at:open_at]
                slot = sentence[open_at + 1 : close]
                value = filler.fill(slot)
                if slot in LABELS_OF:
                    spans.append((len(text), len(text) + len(value), LABELS_OF[slot]))
                text += value
                at = close + 1
            text += sentence[at:]
        if r.random() < 0.08 and len(text.upper()) == len(text):
            text = text.upper()
        table.append((text, spans))
    return table
