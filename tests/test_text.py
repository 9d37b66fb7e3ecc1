import pytest

from reportlake.functions import scalars, text


def apply(spark, function, value, **options):
    row = spark.createDataFrame([(value,)], "t string")
    return row.select(function("t", **options)).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a\r\nb\rc", "a\nb\nc"),
        ("a\n \t\n\n\nb", "a\n\nb"),
        ("-5 mm", "5 mm"),
        ("a\n- \nb", "a\nb"),
        ("*** Head ***\nx", "Head:\nx"),
        ("*** A *** *** B ***", "A: B:"),
        ("***  ***", ":"),
        ("1) x\n 2.\ty", "1. x\n2. y"),
        ("--- BEGIN REPORT ---\nx\n--- end report ---", "x"),
        ("\u2022 x \u2192 y \u00d7 2", "x -> y x 2"),
        ("\u00a0x\u00a0", "x"),
        ("", ""),
        (None, None),
    ],
)
def test_preprocess(spark, raw, expected):
    assert apply(spark, text.preprocess_report, raw) == expected
    assert apply(spark, text.preprocess_report, expected) == expected


def test_line_starts_are_newlines_only(spark):
    assert apply(spark, text.drop_line_bullets, "a\u2028- b") == "a\u2028- b"
    assert apply(spark, text.drop_line_bullets, "a\n- b") == "a\nb"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("n\u00c3\u00a3o", "n\u00e3o"),
        ("it\u00e2\u20ac\u2122s", "it's"),
        ("cafe\u0301", "caf\u00e9"),
        ("a &amp; b", "a & b"),
        ("<b> &amp;", "<b> &amp;"),
        ("\uff21\uff22\u3000\uff11", "AB 1"),
        ("\u201cx\u2019\ufb01", "\"x'fi"),
        ("a\x07b\ufeff\x1b[31mc", "abc"),
        ("a\u2028b\r\nc", "a\nb\nc"),
        ("N\u00c3O \u00c2 ", "N\u00c3O \u00c2 "),
        (None, None),
    ],
)
def test_repair_unicode(spark, raw, expected):
    assert apply(spark, text.repair_unicode, raw) == expected


def test_only_the_repair_uses_python(spark, plan_of):
    row = spark.createDataFrame([("x",)], "t string")
    assert "Python" not in plan_of(row.select(text.preprocess_report("t", repair=False)))
    assert "ArrowEvalPython" in plan_of(row.select(text.preprocess_report("t")))


def test_strip_takes_all_unicode_blanks(spark):
    blanks = scalars.BLANK_CHARS
    assert blanks.strip() == "" and len(blanks) == 29
    assert apply(spark, scalars.strip, f"{blanks}a b{blanks}") == "a b"


def test_short_label_always_has_dots(spark):
    assert apply(spark, scalars.short_label, "x" * 60) == "x" * 50 + "..."
    assert apply(spark, scalars.short_label, "short") == "short..."


def test_json_keeps_or_drops_nulls(spark):
    row = spark.sql("select named_struct('a', cast(null as string), 'b', 'é') as s, array() as e")
    from pyspark.sql import functions as F

    assert row.select(scalars.to_json_keeping_nulls("s")).first()[0] == '{"a":null,"b":"é"}'
    assert row.select(F.to_json("s")).first()[0] == '{"b":"é"}'
    assert row.select(scalars.empty_to_null("e")).first()[0] is None


def test_display_time_reads_iso_text(spark):
    row = spark.createDataFrame([("2025-11-18T02:05:09.123456",)], "t string")
    assert row.select(scalars.display_time("t")).first()[0] == "18/11/2025 02:05"


@pytest.mark.parametrize(
    "whole",
    ["é", "à noite", "fi", "łódź", "Ångström", "αβγ", "Привет", "œuvre", "“quoted”", "x – y", "日本語", "🙂🙂", "שלום", "İstanbul şehir"],
)
@pytest.mark.parametrize("times", [1, 2])
def test_damage_is_undone_also_when_it_was_repeated(whole, times):
    def damage(text):
        return "".join(bytes([b]).decode("windows-1252", errors="ignore") or chr(b) for b in text.encode())

    broken = whole
    for _ in range(times):
        broken = damage(broken)
    assert text.undo_mojibake(broken) == whole


@pytest.mark.parametrize(
    "plain", ["CAFÉ» e", "NÃO – sim", "É–", "PAÍS “x”", "à é î ô", "Ð alone", "ÀÉÎÕÜ", "café”»", "100 £ ± 5 °C", "Ñ", "SÃO"]
)
def test_ordinary_text_stays(plain):
    assert text.undo_mojibake(plain) == plain
