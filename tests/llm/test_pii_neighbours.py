"""Phone numbers with another value right behind them."""

import pytest

from loomline.llm import pii

PHONES = ["+1 (826) 555-4081", "+1 826 555 4081", "+1-826-555-4081", "+18265554081", "+1 8265554081", "+44 20 7946 0958", "+44 (20) 7946 0958", "+49 30 123 4567", "+44 7911 123456", "(826) 555-4081", "826-555-4081"]
OTHERS = {"ip": "190.137.223.204", "card": "4539 1488 0343 6467", "date": "1987-03-09", "ssn": "123-45-6789", "email": "12.ann@mail3.example.com", "phone": "826.555.4082"}


@pytest.mark.parametrize("phone", PHONES)
def test_a_phone_ends_where_another_value_begins(phone):
    alone = pii.pseudonym("phone", phone)
    for kind, value in OTHERS.items():
        text = f"x {phone} {value} y"
        new, spans = pii.replace(text)
        assert [(k, text[s:e]) for k, s, e in spans] == [("phone", phone), (kind, value)]
        assert new == f"x {alone} {pii.pseudonym(kind, value)} y"
        assert pii.replace(new, "decrypt")[0] == text
    for year in ("1999", "2019", "2019.", "2019, "):
        text = f"x {phone} {year} y"
        new, spans = pii.replace(text)
        assert new == f"x {alone} {year} y" and [text[s:e] for _, s, e in spans] == [phone]
        assert pii.replace(new, "decrypt")[0] == text


@pytest.mark.parametrize("phone", ["+49 30 123 4567 89", "+49 151 123456 78", "+49 30 12 34 56", "+1.826.555.4081", "+33 612 34 56 78", "+1-826-555-4081-22", "+49 30 555 2019"])
def test_other_groupings_stay_whole(phone):
    text = f"x {phone}, y"
    assert [text[s:e] for _, s, e in pii.replace(text)[1]] == [phone]
