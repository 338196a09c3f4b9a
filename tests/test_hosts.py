"""Normal forms of hosts; expected values by hand from the public standards."""

import pytest

from pageloom.functions.hosts import ascii_name, ipv4, ipv6, normal_host


@pytest.mark.parametrize("host, want", [
    ("EXAMPLE.com", "example.com"), ("ex%41mple.com", "example.com"), ("bücher.de", "xn--bcher-kva.de"),
    ("BÜCHER.de", "xn--bcher-kva.de"), ("bücher.de", "xn--bcher-kva.de"), ("b%C3%BCcher.de", "xn--bcher-kva.de"),
    ("XN--BCHER-KVA.de", "xn--bcher-kva.de"), ("faß.de", "xn--fa-hia.de"), ("FAẞ.de", "xn--fa-hia.de"),
    ("βόλος.com", "xn--nxasmm1c.com"), ("☃.net", "xn--n3h.net"),
    ("例え.テスト", "xn--r8jz45g.xn--zckzah"), ("a。b．c｡d", "a.b.c.d"),
    ("ex­am​ple.com", "example.com"), ("ＧＯ.com", "go.com"), ("אב.co.il", "xn--4dbc.co.il"),
    ("a_b.c~d", "a_b.c~d"), ("a..b.", "a..b."), ("a{b}", "a{b}"), ("1.2.3.4.com", "1.2.3.4.com"),
    ("xn--a", None), ("xn--bcher-kva8.de", None), ("xn--", None), ("a b", None), ("a%2Fb", None), ("a%zz", None), ("%FF.com", None),
    ("́a.com", None), ("a.com", None), ("a͸.com", None), ("אa.com", None), ("a‌b.com", None), ("%00", None),
    ("​", None), ("a^b", None), ("", None),
])
def test_names(host, want):
    assert normal_host(host) == want


@pytest.mark.parametrize("host, want", [
    ("1.2.3.4", "1.2.3.4"), ("1.2.3.4.", "1.2.3.4"), ("127.1", "127.0.0.1"), ("0x7F.1", "127.0.0.1"), ("017700000001", "127.0.0.1"),
    ("4294967295", "255.255.255.255"), ("0x", "0.0.0.0"), ("1.0x10", "1.0.0.16"), ("１.2.3.4", "1.2.3.4"), ("%31.2.3.4", "1.2.3.4"),
    ("4294967296", None), ("1.2.3.256", None), ("1.256.1", None), ("1.2.3.4.5", None), ("09", None), ("1..2", None), ("a.0x1", None),
    ("1.2.3.08", None),
])
def test_numbers(host, want):
    assert normal_host(host) == want


@pytest.mark.parametrize("text, want", [
    ("::", "::"), ("::1", "::1"), ("1::", "1::"), ("2001:0DB8::0:1", "2001:db8::1"), ("1:0:0:2:0:0:0:3", "1:0:0:2::3"),
    ("1:0:0:2:3:0:0:4", "1::2:3:0:0:4"), ("0:1:2:3:4:5:6:7", "0:1:2:3:4:5:6:7"), ("::ffff:1.2.3.4", "::ffff:102:304"),
    ("1:2:3:4:5:6:7.8.9.10", "1:2:3:4:5:6:708:90a"), ("1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:0"),
    ("", None), (":", None), (":::", None), ("1:2", None), ("1::2::3", None), ("1:2:3:4:5:6:7:8:9", None), ("1:2:3:4:5:6:7:8::", None),
    ("12345::", None), ("::1.2.3", None), ("::01.2.3.4", None), ("1.2.3.4::", None), ("::g", None), ("fe80::1%eth0", None), (":1::", None),
])
def test_bracketed(text, want):
    assert ipv6(text) == want
    assert normal_host(f"[{text}]") == (None if want is None else f"[{want}]")


def test_every_letter_survives_a_round_trip():
    for code in range(0xC0, 0x2000):
        name = ascii_name("a" + chr(code) + "b")
        if name and name.startswith("xn--"):
            assert ascii_name(name) == name
            assert ascii_name(name[4:].encode().decode("punycode")) == name


def test_long_numbers_and_names_are_cheap():
    assert ipv4("9" * 100_000) is None
    assert len(normal_host("bü" + "a" * 2000)) > 2000
