"""Addresses in running text, part by part, and in texts of a million characters."""

import time

import pytest

from snarewatch.functions.addresses import addresses, spans


@pytest.mark.parametrize("text,want", [
    ("see https://ababank.com or bit.ly/x9 and mail me", ["https://ababank.com", "bit.ly/x9"]),
    ("go to real-bank.com@evil-site.tk now", ["real-bank.com@evil-site.tk"]),
    ("abab@nk.com", ["abab@nk.com"]), ("a@b@c.com", ["b@c.com"]), ("http://u_%x@h.org:8080/p?q", ["http://u_%x@h.org:8080/p?q"]),
    ("http://203.0.113.5/", ["http://203.0.113.5/"]), ("203.0.113.5:81 203.0.113.5:8", ["203.0.113.5:81", "203.0.113.5"]),
    ("see 203.example.com", ["203.example.com"]), ("v1.2.3.4x 1234.5.6.7 1.2.3.4567", ["1.2.3.4", "234.5.6.7", "1.2.3.456"]), ("1.2.3", []),
    ("HTTPS://Foo.COM/A foo.com/a", ["HTTPS://Foo.COM/A", "foo.com/a"]), ("foo.com FOO.com", ["foo.com"]),
    ("http//ababamk.com/secure/1", ["ababamk.com/secure/1"]), ("ftp://foo.com xhttps://bar.com", ["foo.com", "https://bar.com"]),
    ("(foo.com/a), <bar.org/b>. baz.net/c!?'", ["foo.com/a", "bar.org/b", "baz.net/c"]), ("foo.com,bar.com;", ["foo.com", "bar.com"]),
    ("a_b.com x..y.com -foo.com foo-.com foo.-com", ["b.com", "y.com", "foo.com"]), ("foo.c0m foo.bar.c0m foo.com1 foo.com1.net", ["foo.bar", "foo.com", "foo.com1.net"]),
    ("and/or.com/x end. The e.g. i.e", ["or.com/x"]), (f"{'a' * 70}.com", [f"{'a' * 63}.com"]), (f"a.{'b' * 30}", [f"a.{'b' * 24}"]),
    ("ខ្មែរfoo.comខ្មែរ http://foo.com/ខ្មែរ", ["foo.com", "http://foo.com/ខ្មែរ"]), ("", []), (None, []), ("http://http://foo.com", ["http://foo.com"]), ("a.b@c a.bc@d", ["a.bc"]),
])
def test_addresses(text, want):
    assert addresses(text) == want


def test_spans_are_in_order_and_apart():
    text = "x foo.com_bar.com%baz.org/p?q=a.b, 1.2.3.4.5.6.7.8 u@v.com:99999/"
    found = spans(text)
    assert all(a < b for a, b in found) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
    assert [text[a:b] for a, b in found] == ["foo.com", "bar.com", "baz.org/p?q=a.b,", "1.2.3.4", "5.6.7.8", "u@v.com:99999/"]


@pytest.mark.parametrize("piece", ["a", "a.", "1.", "a@", "-.", "a.b@", "ab.", "http://", "a_b.c"])
def test_a_million_characters_without_a_blank_take_linear_time(piece):
    text = (piece * 1_000_000)[:1_000_000]
    start = time.perf_counter()
    spans(text + "!foo.com")
    assert time.perf_counter() - start < 8
