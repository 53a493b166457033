"""Personal data is found at its place in the original text, however it is written."""

import __spark_entry__
from tilewright.llm import personal


def kinds(text):
    return [(k, text[a:b]) for k, a, b in personal.spans(text)]


def test_registered():
    assert "p9_found" in __spark_entry__.queries()


def test_hidden_emails_and_broken_lines():
    text = "go to  a_b+court [at] inbox\n[dot] invalid or wil-\r\nma at tarn dot chambers dot example."
    assert [t for _, t in kinds(text)] == ["a_b+court [at] inbox\n[dot] invalid", "wil-\r\nma at tarn dot chambers dot example"]


def test_numbers_by_label_and_shape():
    text = "gave her passport no. as 00232627830 and her telephone number as 030 23125 160; the caller used 555-0123 (069/90009690). Invoice 88-9231-1867, s. 12(3) at 020-5111, reference 0043-4395-9692."
    assert kinds(text) == [("id_number", "00232627830"), ("phone", "030 23125 160"), ("phone", "555-0123"), ("phone", "069/90009690")]


def test_addresses():
    text = "found at Flat 25, 231 Tollgate's Rd, Eastmarch; wohnhaft Weidendammallee 49B, 00027 X; demeurant 202 bis, place de la Corderie."
    assert [t for k, t in kinds(text) if k == "address"] == ["Flat 25, 231 Tollgate's Rd", "Weidendammallee 49B", "202 bis, place de la Corderie"]


def test_names_without_title_and_not_in_citations():
    text = "MS RUNE BROVELIK v Kirren Power plc\nBefore: Dr Zita Quillamaud, Mr X\nAccording to Jolvakova, Brita, see Vellumaud v Tolland Shipping [1979] 6 ZLR 1; Mrs T. and R. van der Ostrevez."
    assert [t for _, t in kinds(text)] == ["RUNE BROVELIK", "Zita Quillamaud", "Jolvakova, Brita", "R. van der Ostrevez"]


def test_placeholders():
    assert personal.replaced("Mr Wexum, 020 7946 0633.") == "Mr [NAME], [PHONE]."


def test_transducers_keep_offsets():
    text = "Call zero two zero, seven nine four six zero six three three now. Mail klаra (аt) inbox\n[dot] invalid, ｋｉｍ＠inbox.test; Für­st at a dot test"
    tape = personal.normalised(text)
    assert "020 79460633 now" in tape.text and "kim@inbox.test" in tape.text and "Fürst@a.test" in tape.text
    at = tape.text.index("020 79460633")
    a, b = tape.source(at, at + 12)
    assert text[a:b] == "zero two zero, seven nine four six zero six three three"
    assert [t for k, t in kinds(text) if k == "email"] == ["klаra (аt) inbox\n[dot] invalid", "ｋｉｍ＠inbox.test", "Für­st at a dot test"]
    assert [t for k, t in kinds(text) if k == "phone"] == ["zero two zero, seven nine four six zero six three three"]


def test_few_spelt_digits_stay():
    text = "one two three steps, and one or two more"
    assert personal.normalised(text).text == text


def test_every_character_maps_to_its_own():
    text = "A  b-\r\nc d\n\n> e [at] f\tg"
    tape = personal.normalised(text)
    for i, c in enumerate(tape.text):
        a, b = tape.source(i, i + 1)
        assert 0 <= a <= b <= len(text) and (text[a:b] == c or not text[a:b].isalnum())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a@b.test", "x"), (3, "write to a@b.test. " * 3000, "x")], "doc_id long, text string, kind string")
    got = personal.found(df).collect()
    assert len(got) == 3000 and {r["doc_id"] for r in got} == {3} and max(r["start_pos"] for r in got) == 19 * 2999 + 9
    texts = {r["doc_id"]: r["text"] for r in personal.redacted(df).collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == "write to [EMAIL]. " * 3000 and texts[None] == "[EMAIL]"
    assert personal.found(df.limit(0)).count() == 0


def test_names_over_line_ends():
    text = "For the appellant: Torvasko, Rune\r\nPetition – Mortgage. Papers were served on O.\nHalquin at noon. It was put to Dr\n\nPage 2 of 2\n\nNorvask again.\nBefore: Mr X.\nPatent – Lease"
    assert [t for k, t in kinds(text) if k == "name"] == ["Torvasko, Rune", "O.\nHalquin", "Norvask"]
