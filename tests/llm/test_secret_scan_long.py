"""Very long runs, bombs beside secrets, and the rarer codes."""

import base64
import gzip
import random
import time

import pytest

from ensemblar.llm import secret_scan

SECRET = "password=hunter2hunter2"
RANDOM = random.Random(11).randbytes(750_000)
LONG = {
    "one letter": "A" * 1_000_000,
    "hex": RANDOM[:500_000].hex(),
    "base64": base64.b64encode(RANDOM).decode(),
    "wrapped base64": base64.encodebytes(RANDOM).decode(),
    "written breaks": base64.encodebytes(RANDOM).decode().replace("\n", "\\n"),
    "short runs": "abcdefghijklmno " * 60_000,
    "breaks without runs": "abc\n" * 250_000,
    "keywords": "token " * 160_000,
}


@pytest.mark.parametrize("name", LONG)
def test_time_is_in_proportion(name):
    text = LONG[name] + " " + SECRET
    began = time.process_time()
    spans = secret_scan.find_secrets(text)[0]
    assert time.process_time() - began < 10
    assert ("assign", len(text) - len(SECRET), len(text), False) in spans


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"])
def test_wide_text(encoding):
    text = "see " + base64.b64encode(f"some words, {SECRET}".encode(encoding)).decode() + " there"
    spans = secret_scan.find_secrets(text)[0]
    assert [x[0] for x in spans if x[3]] == ["assign"]
    # as it is, with its zeros
    plain = "".join(c + "\0" * 3 for c in SECRET)
    (span,) = secret_scan.find_secrets("x " + plain)[0]
    assert span[:2] == ("assign", 2) and span[3]


def test_percent_u():
    coded = "".join(f"%u{ord(c):04X}" for c in SECRET)
    (span,) = secret_scan.find_secrets(f"é {coded} end")[0]
    assert span == ("assign", 2, 2 + len(coded), True)


def test_a_bomb_does_not_hide_what_follows():
    bomb = base64.b64encode(gzip.compress(bytes(40_000_000))).decode()
    other = base64.b64encode(gzip.compress(b"some words and " + SECRET.encode())).decode()
    for text in (f"{bomb} {other}", f"{bomb} {bomb[:-8]} {other}", f"{other} {bomb}"):
        spans, _, cut_off = secret_scan.find_secrets(text, 4_000_000)
        assert cut_off and [x[0] for x in spans] == ["assign"]
        at = text.index(other)
        assert at <= spans[0][1] < spans[0][2] <= at + len(other)


def test_a_large_layer_is_read_to_its_end():
    body = b" " * 5_000_000 + SECRET.encode()
    spans, _, cut_off = secret_scan.find_secrets(base64.b64encode(gzip.compress(body)).decode(), 6_000_000)
    assert len(spans) == 1 and not cut_off
