import random
from datetime import date, datetime

from pyspark.sql import functions as F

from cupboard import registry
from cupboard.functions.dates import parse_date, shift_months
from cupboard.plans.analytics import months_back

DAY = date(2026, 3, 10)


def parsed(values, texts, formats, iso=True):
    return values(lambda c: parse_date(c, formats, iso), texts)


def test_slash_dash_and_japanese(values):
    texts = ["2026/03/10", "2026-03-10", "2026年3月10日", " 2026/3/10 ", "２０２６/０３/１０", "　2026/03/10"]
    assert parsed(values, texts, registry.SHOP_A_DATES, False) == [DAY] * 6


def test_us_order_depends_on_the_list(values):
    assert parsed(values, ["03/10/2026"], registry.SHOP_A_DATES, False) == [DAY]
    assert parsed(values, ["03/10/2026"], registry.FORMATS["amazon_jp"]["date_formats"]) == [None]


def test_month_names_in_any_case(values):
    formats = registry.FORMATS["ebay"]["date_formats"]
    assert parsed(values, ["Mar-10-26", "MAR-10-26", "mar 10, 2026", "Mar  10,  2026"], formats) == [DAY] * 4


def test_two_digit_years_turn_at_69(values):
    got = parsed(values, ["03/10/75", "03/10/69", "03/10/68", "02/29/00"], ["%m/%d/%y"])
    assert got == [date(1975, 3, 10), date(1969, 3, 10), date(2068, 3, 10), date(2000, 2, 29)]


def test_offset_keeps_the_local_day(values):
    texts = ["2026-03-10T23:30:00-08:00", "2026-03-10T23:30:00-0800", "2026-03-10T23:30:00Z", "2026-03-10 23:30", "20260310"]
    assert parsed(values, texts, ["%Y/%m/%d"]) == [DAY] * 5
    assert parsed(values, texts[:3], registry.FORMATS["shopify"]["date_formats"], False) == [DAY] * 3


def test_rejected(values):
    texts = ["2026/03/01 x", "2026/02/30", "", None, "2026/003/10", "0000/01/01", "2026/13/01", "12026/03/10", "26/03/10"]
    assert parsed(values, texts, ["%Y/%m/%d"]) == [None] * len(texts)


def test_no_iso_fallback_for_the_shops(values):
    assert parsed(values, ["2026-03-10T10:00:00"], registry.SHOP_A_DATES, False) == [None]
    assert parsed(values, ["2026/03/10 9:05:00", "2026/03/10 09:05"], registry.SHOP_B_DATES, False) == [DAY] * 2


def test_agrees_with_strptime(values):
    rng = random.Random(5)
    for formats in [f["date_formats"] for f in registry.FORMATS.values()] + [registry.SHOP_B_DATES]:
        texts = []
        for _ in range(60):
            moment = datetime(rng.randint(1970, 2060), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), 5, 9)
            text = moment.strftime(rng.choice(formats).replace("%z", rng.choice(["Z", "+0900", "-08:00"])))
            if rng.random() < 0.3:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice("0139/-: x") + text[at + 1:]
            texts.append(text)
        want = []
        for text in texts:
            found = None
            for fmt in formats:
                try:
                    found = datetime.strptime(text.strip(), fmt).date()
                    break
                except ValueError:
                    continue
            want.append(found)
        assert parsed(values, texts, formats, False) == want


def test_month_shift_overflows(spark, values):
    got = values(lambda c: shift_months(c.cast("date"), -6), ["2026-08-31", "2001-07-20"])
    assert got == [date(2026, 3, 3), date(2001, 1, 20)]
    assert months_back(datetime(2026, 8, 31), 6) == date(2026, 3, 3)
    assert months_back(datetime(2024, 2, 29), 12) == date(2023, 3, 1)
    plain = spark.range(1).select(F.add_months(F.lit(date(2026, 8, 31)), -6)).first()[0]
    assert plain == date(2026, 2, 28)
