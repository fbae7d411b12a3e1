"""Sentences with marked personal data, from which the span model is fitted.

``{kind}`` stands for a drawn value of that kind and is marked; ``{kind:form}`` draws one form of it;
``{~form}`` draws a value that looks like one and is none. Values are drawn with a fixed seed.
"""

from __future__ import annotations

import random
import re

KINDS = ["email", "ip", "card", "phone", "secret", "account", "birth", "name"]

SENTENCES = """
Please call {phone} before noon.
You can call us at {phone} or write to {email:at}.
Call {phone:local} or {phone:local} for a table.
My phone number is {phone:local}, ask for Anna.
Phone: {phone:local}
phone {phone:plain} after six
Tel. {phone:local} / Fax {phone:local}
tel {phone:plain}
Mobile {phone:plain}
Telefon: {phone:local}
Sie erreichen uns unter Tel. {phone:plain} von neun bis elf.
Rufen Sie {phone:local} an.
Appelez le {phone:pairs} le matin.
Téléphone : {phone:pairs}
Tél. {phone:pairs}
Llame al {phone:local} por la tarde.
Teléfono {phone:plain}
Teléfono: {phone:local}
contact me on {phone:local} please
{phone:local}
{phone:local} again
fax {phone:local} first
dial {phone:local} or {phone:pairs}
und {phone:local} oder {phone:local}
{email:at}
{phone:pairs} et {email:at} aussi
la dame {email:at} ici
und {email:at} oder {email:at}
{ip:six}
ping {ip:six} twice
from {ip:six} to {ip:six}
der Rechner {ip:six} läuft
Call {phone:plus} 190.137.223.20 again
{phone:plus} 81.20.146.7 4539148803436467
und {phone:plus} 4539148803436467 oder
Write to {email:at} for the draft.
Mail {email:at}
E-mail: {email:at}
Schreiben Sie an {email:at} bitte.
Écrivez à {email:at} pour en savoir plus.
Escriba a {email:at} sin falta.
contact {email:at} and {email:at}
The card {card:dots} was charged.
Card number: {card:dots}
pay with {card:slashes} today
Kreditkarte {card:dots} gültig bis Mai
carte {card:slashes} refusée
tarjeta {card:dots} caducada
card no. {card:dots} and {card:slashes}
The server answers at {ip:six} again.
ssh root {ip:six}
Die Adresse {ip:six} ist gesperrt.
adresse {ip:six} bloquée
Login from {ip:six} failed.
host {ip:six} port
token = "{secret:hex}"
the token = "{secret:hex}" of the build
TOKEN = "{secret:hex}"
token: {secret:mixed}
api_key = "{secret:mixed}"
api_key={secret:mixed}
password = "{secret:mixed}"
secret: "{secret:hex}"
secret_key = '{secret:mixed}'
export ACCESS_KEY={secret:upper}
Authorization: Bearer {secret:mixed}
clef secrète token = "{secret:hex}" fin
key = {secret:prefixed}
set {secret:prefixed} in the file
el token = "{secret:hex}" y que
und token = "{secret:hex}"
IBAN {account}
Please pay to {account} by Friday.
Konto {account:spaced} bei der Bank
IBAN: {account:spaced}
versez sur le compte {account:spaced} demain
cuenta {account}
account {account} and {account:spaced}
born on {birth}
She was born {birth} in Lyon.
Date of birth: {birth}
DOB: {birth}
geboren am {birth:dots} in Kiel
Geburtsdatum: {birth:dots}
née le {birth} à Metz
né le {birth}
Date de naissance : {birth}
nacido el {birth} en Soria
fecha de nacimiento: {birth}
My name is {name} and I live here.
Dear Mr. {name}, we thank you.
Dear Mrs {name}
Ask Dr. {name} about it.
Name: {name}
Mein Name ist {name}.
Sehr geehrte Frau {name}, wir danken.
Herr {name} kommt morgen.
Monsieur {name} est parti.
Mme {name} arrive.
Señora {name} viene hoy.
Sr. {name} y familia
Name: {name} Tel. {phone:plain}
Mr. {name}, born {birth}, phone {phone:local}
Name: {name}, IBAN {account}
On {~date} the talk began.
The meeting of {~date} was moved to {~date}.
Released {~date} as version {~version}.
published on {~date}
Le {~date} nous partons.
Am {~date} beginnt die Messe.
El {~date} empieza.
Version {~version} is out.
licensed under the GNU General Public License, version {~small}.
Licensed under CC BY-NC {~version}.
section {~version} of chapter {~small}
It costs {~price} in all.
{~price} per month
Das kostet {~price} im Monat.
cela coûte {~price} par mois
Order {~long} has shipped.
Order number {~long}
invoice {~long} of {~date}
The number {~long} is not prime.
part no. {~long}
Bestellnummer {~long}
commande {~long} livrée
pedido {~long}
ISBN {~isbn}
ISBN: {~isbn}
commit {~hash} fixes it
commit {~hash}
md5 {~hash} of the file
sha1 {~hash}
checksum: {~hash}
At {~time} the train left.
from {~time} to {~time}
um {~time} Uhr
{~small} of {~small} people
page {~small} to {~small}
pages {~small}-{~small}
in {~year} and {~year}
between {~year} and {~year} it grew by {~small} %
The score was {~small}:{~small}.
room {~small}, floor {~small}
{~small}. {~small}. {~small}.
{~version} {~version} {~version}
numbers {~small} {~small} {~small} {~small}
rows {~small}, {~small}, {~small} and {~small}
{~long} rows were read
a total of {~long} visits
The Name of the Rose is a book.
Mr. and Mrs. went home.
Dear All, hello.
The name of the file is long.
Dear Sir or Madam
follow @{~word} for news
meet @ {~time}
the ratio {~small}/{~small} holds
{~long}/{~long}
id {~long}
{~long} {~long}
model {~code} is new
type {~code} or {~code}
"""

_FIRST = "Anna Paul Maria Jonas Claire Diego Lucía Peter Sofie Marc Elena Tom".split()
_LAST = "Berger Smith Dupont García Keller Moreau Novak Jensen Ortega Brown Lindqvist Fischer".split()
_HOSTS = "mail web post corp uni home".split()
_ENDS = "com org net de fr es".split()


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _luhn(rng: random.Random) -> str:
    body = rng.choice("3456") + _digits(rng, 14)
    odd = [int(c) for c in body[1::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in body[::2]]
    return body + str(-(sum(odd) + sum(even)) % 10)


def _iban(rng: random.Random) -> str:
    land, body = rng.choice(["DE", "FR", "ES", "NL"]), _digits(rng, 18)
    number = int(body + "".join(str(ord(c) - 55) for c in land) + "00")
    return f"{land}{98 - number % 97:02d}{body}"


def _groups(text: str, n: int, by: str) -> str:
    return by.join(text[k : k + n] for k in range(0, len(text), n))


def _date(rng: random.Random, form: str) -> str:
    d, m, y = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1940, 2024)
    return {"dots": f"{d:02d}.{m:02d}.{y}", "slashes": f"{d:02d}/{m:02d}/{y}", "dashes": f"{y}-{m:02d}-{d:02d}"}[form]


def draw(rng: random.Random, kind: str, form: str) -> str:
    """A value of a kind; an empty form draws any."""
    d = lambda n: _digits(rng, n)
    if kind == "phone":
        form = form or rng.choice(["local", "plain", "pairs"])
        local = [f"({d(3)}) {d(3)}-{d(4)}", f"{rng.randint(200, 999)}-{d(3)}-{d(4)}", f"0{rng.randint(20, 999)}/{d(7)}", f"0{rng.randint(20, 999)} {d(6)}", f"{rng.randint(200, 999)}.{d(3)}.{d(4)}"]
        return {"local": rng.choice(local), "plain": f"0{rng.randint(10, 99)}{d(7)}", "plus": f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", "pairs": "0" + d(1) + " " + _groups(d(8), 2, " ")}[form]
    if kind == "email":
        user = rng.choice([rng.choice(_FIRST), rng.choice(_FIRST) + "." + rng.choice(_LAST), rng.choice(_LAST) + d(2)]).lower()
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" (at) ", ".")])
        return user + at + rng.choice(_HOSTS) + dot + rng.choice(_ENDS)
    if kind == "card":
        return _groups(_luhn(rng), 4, "/" if form == "slashes" else ".")
    if kind == "ip":
        parts = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
        return rng.choice([":".join(parts), "2001:db8::" + d(1) + parts[0], "fe80::" + ":".join(parts[:3]) + ":" + d(2)])
    if kind == "secret":
        form = form or rng.choice(["hex", "mixed"])
        letters = "abcdefghijklmnopqrstuvwxyz"
        mixed = "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(rng.randint(18, 40))) + d(2)
        return {"hex": f"{rng.getrandbits(152):038x}" + d(2), "mixed": mixed, "upper": mixed.upper()[:20] + d(2), "prefixed": rng.choice(["sk_live_", "ghp_", "AKIA"]) + mixed}[form]
    if kind == "account":
        return _groups(_iban(rng), 4, " ") if form == "spaced" else _iban(rng)
    if kind == "birth":
        return _date(rng, form or rng.choice(["slashes", "dashes", "dots"]))
    if kind == "name":
        return rng.choice([f"{rng.choice(_FIRST)} {rng.choice(_LAST)}", rng.choice(_LAST), f"{rng.choice(_FIRST)} {rng.choice(_FIRST)[0]}. {rng.choice(_LAST)}"])
    other = {
        "date": lambda: _date(rng, rng.choice(["slashes", "dashes", "dots"])),
        "version": lambda: ".".join(str(rng.randint(0, 12)) for _ in range(rng.randint(2, 3))),
        "small": lambda: str(rng.randint(0, 400)),
        "year": lambda: str(rng.randint(1900, 2030)),
        "price": lambda: rng.choice(["$", "€", ""]) + f"{rng.randint(1, 9999)}.{d(2)}",
        "long": lambda: str(rng.randint(1, 9)) + d(rng.randint(4, 17)),
        "isbn": lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        "hash": lambda: f"{rng.getrandbits(160):040x}"[: rng.choice([32, 40])],
        "time": lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02d}",
        "word": lambda: rng.choice(_LAST).lower() + d(1),
        "code": lambda: rng.choice("ABCDEFG") + rng.choice("KLMNOP") + "-" + d(3),
    }
    return other[form]()


MARK = re.compile(r"\{(~?)(\w+)(?::(\w+))?\}")


def labelled(sentences: str = SENTENCES, each: int = 3, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Every sentence ``each`` times with drawn values: its text, and the start, end and kind of its spans."""
    rng, out = random.Random(seed), []
    for line in sentences.strip().splitlines():
        for _ in range(each):
            text, spans, at = "", [], 0
            for m in MARK.finditer(line):
                text += line[at : m.start()]
                value = draw(rng, "", m[2]) if m[1] else draw(rng, m[2], m[3] or "")
                if not m[1]:
                    spans.append((len(text), len(text) + len(value), m[2]))
                text, at = text + value, m.end()
            out.append((text + line[at:], spans))
    return out
