from pyspark.sql import functions as F

from confab.functions import clock, text
from confab.operators import metrics, segments


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "\u00a0 a\r\nb  \r\r\r\rc\x1c ", text.normalise) == "a\nb\n\nc"
    assert one(spark, "```json\n{}\n```", text.strip_fence) == "{}"
    assert one(spark, "```json\n{}", text.strip_fence) == "```json\n{}"
    assert one(spark, "They talked about it", text.professional) == "Participants reviewed it."
    assert one(spark, "they talked about it!", text.professional) == "They talked about it!"
    assert one(spark, "  ", text.professional) == ""
    assert one(spark, "$1 \\", lambda c: text.fill("a {transcript} b {transcript}", c)) == "a $1 \\ b $1 \\"
    assert one(spark, "<a & 'b'>", text.html_escape) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, "", lambda c: text.mask(c, "missing")) == "missing"
    assert one(spark, "/x/Notes.TXT", text.suffix) == "txt"
    assert one(spark, "Speaker 1 [00:00 - 00:05]\nlets use teh api", text.rule_cleanup) == "Speaker 1 [00:00 - 00:05]\nLet's use the API."


def test_clocks(spark):
    for value, want in ((None, "--:--"), (2.5, "00:02"), (3.5, "00:04"), (-4.0, "00:00"), (3599.5, "01:00:00"), (59.6, "01:00")):
        assert one(spark, value, clock.format_clock, "double") == want
    for value, want in (("1:02", 62.0), ("1:02:03.5", 3723.5), ("7", 7.0), ("5d", None), ("a:b", None), ("99:99", 6039.0), ("", None)):
        assert one(spark, value, clock.parse_clock) == want
    assert one(spark, 12.25, clock.format_elapsed, "double") == "12.2s"
    assert one(spark, 59.96, clock.format_elapsed, "double") == "60.0s"
    assert one(spark, 119.5, clock.format_elapsed, "double") == "2m 0s"
    assert one(spark, 61.0005, clock.format_clock_ms, "double") == "01:01.000"


def test_labels_and_headers(spark):
    for value, want in ((None, "Speaker"), ("0", "Speaker 1"), ("speakerX", "speakerX"), ("Host", "Speaker Host"), ("", "Speaker ")):
        assert one(spark, value, segments.speaker_label) == want
    for value, want in (("Speaker 3", "2"), ("Speaker 0", "0"), ("SPK  A", "SPK A")):
        assert one(spark, value, segments.speaker_id_of) == want
    t = "Speaker 1 [00:01 - 00:02]\nhi\nSpeaker 2: inline\nspeaker x:\nSpeaker [a - b]"
    assert one(spark, t, segments.header_count) == 2


def test_parse_segments(spark):
    t = "before\nSpeaker 1 [1:02 - 1:03.5]\nhello\n\nthere\nSpeakers were asked\nSPK-2:\nSpeaker Rahul [--:-- - --:--]\nSpeaker 2: bye"
    got = [tuple(x) for x in one(spark, t, segments.parse_segments)]
    assert got == [("hello there", "0", 62.0, 63.5), ("were asked", "Speakers", None, None), ("[--:-- - --:--]", "Speaker Rahul", None, None), ("bye", "1", None, None)]
    assert one(spark, "", segments.parse_segments) == []


def test_text_metrics(spark):
    t = "Speaker 1 [00:10 - 00:20]\nx\nSpeaker 2 [00:30 - 02:40]\ny"
    assert one(spark, t, metrics.duration_of_text) == "2 min"
    assert one(spark, "none", metrics.duration_of_text) == "N/A"
    assert one(spark, t + "\nSpeaker 1: z", metrics.speakers_of_text) == 3
