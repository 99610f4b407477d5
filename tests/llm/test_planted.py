"""Personal data in texts written by hand, not by the module's own generator: recall and precision of all spans."""

from __future__ import annotations

import re

from chartspan.llm import personal_data

#: Texts with personal data in «kind:value».
PLANTED = """
Please ring «phone:555-123-4567» before noon.
You can reach our desk on «phone:(212) 555-0188» or by fax «phone:(212) 555-0189».
paid 2024 «card:4111 1111 1111 1111» today
call «phone:555-123-4567» «phone:415-555-2671» now
Mobile: «phone:0171 2345678», office hours only.
Tel. «phone:030/12345678» (Berlin)
Mon téléphone: «phone:01 44 55 66 77», appelez-moi.
contact «email:jane.doe (at) mail (dot) example (dot) org» for details
Write to «email:support [at] shop [dot] example» any time
«email:j_smith@example.co.uk» wrote on 2023-05-06 at 10:30.
Server «ip:192.168.10.254» answered, then 10.0.0.300 did not.
ping «ip:8.8.8.8» -c 4
My visa card is «card:4012-8888-8888-1881», expires 09/27.
card number «card:5555555555554444» exp 12/26
amex «card:378282246310005» please
Her cell is «phone:+1 415 555 2671».
WhatsApp «phone:00 44 20 7946 0958» for bookings
phone «phone:202.555.0143» ext 12
Emergency phone: «phone:212 555 0100», room 12.
sms to «phone:07700 900123» to win
Name: A. B., phone: «phone:617-555-0123», born 1980-02-03
| Ann | «phone:617-555-0199» | 12 |
| Bob | «phone:617-555-0100» | 15 |
Reply to «email:anna.k(at)post.example» soon
Payment by «card:6011 1111 1111 1117» was refused
tel: «phone:617-555-0101», tel: «phone:617-555-0102», tel: «phone:617-555-0103»
call «phone:1-800-555-0199» toll free
fax: «phone:(030) 123 4567»
mobile «phone:0043 664 1234567»
credit «card:4222222222222» of old
"""
#: Texts with none.
CLEAN = """
The meeting is on 2024-01-15 at 10:30, room 12.
Population grew from 1 234 567 to 2 345 678 in 1990.
ISBN 978-3-16-148410-0, second edition.
Version 1.2.3 replaces 1.2.2 of 2019.
Order 123-4567890-1234567 has shipped.
The sum is 1234567890 and not 1234567891.
See pages 100-200 and 345-678 of volume 12.
Invoice no 2023-000-1234 of 12.05.2023
Chapter 3.4.5.6.7 is about tables.
In 2019 2020 2021 2022 we saw growth of 3 4 5 6 percent.
Coordinates 52.5200, 13.4050 and 48.8566, 2.3522
He met her at work.the next day he left
Look at this dot or at that dot here
Serial 0000-1111-2222-3333 is a placeholder, id 4111 1111 1111 1112 is wrong
doi 10.1000/182.1234567
The score was 3-2, 4-1 and 5-0 in 1998-1999.
part number 555-1234-5678-90
1000000 2000000 3000000 4000000
pi is 3.14159265358979
Temperature 20-25, pressure 1013.25, humidity 40-60
The budget of 12 345 678 euros was 1.5 times the 8 230 452 of 2018.
Article 12-345-678 section 9
UTC 2024-05-06T07:08:09.123456
9 8 7 6 5 4 3 2 1 0
tracking number 1Z 999 AA1 01 2345 6784
""".strip().split("\n")
MARKED = re.compile(r"«([a-z]+):([^»]*)»")


def planted(line):
    """(text, spans) of a marked line."""
    text, spans, done = "", set(), 0
    for m in MARKED.finditer(line):
        text += line[done : m.start()]
        spans.add((len(text), len(text) + len(m[2]), personal_data.KINDS.index(m[1])))
        text, done = text + m[2], m.end()
    return text + line[done:], spans


def test_planted_texts():
    model = personal_data.trained()
    lines = [planted(x) for x in PLANTED.strip().split("\n")] + [(x, set()) for x in CLEAN]
    texts = [t for t, _ in lines]
    base = [personal_data.base_spans(t) for t in texts]
    proposed = [set(personal_data.candidates(t, b)) | set(b) for t, b in zip(texts, base)]
    found = [set(b) | set(m) for b, m in zip(base, personal_data.added_spans(texts, base, model))]
    want = sum(len(w) for _, w in lines)
    by_rules = sum(len(w & set(b)) for (_, w), b in zip(lines, base))
    seen, hit, n = sum(len(w & p) for (_, w), p in zip(lines, proposed)), sum(len(w & f) for (_, w), f in zip(lines, found)), sum(map(len, found))
    assert seen == want
    assert hit >= 0.85 * want and hit >= 0.9 * n
