"""Credits in free text, on lines made by hand."""

from cadenza.operators.credits import credits

CASES = {
    "Recorded by Ann Lee": {"recording": "Ann Lee"},
    "recorded & transferred by: Bob O'Neil, Rome": {"recording": "Bob O'Neil", "transfer": "Bob O'Neil"},
    "Recorded, mastered by A. Smith": {"recording": "A. Smith", "mastering": "A. Smith"},
    "edited and mastered by Cy": {"mastering": "Cy"},
    "Taper - Dee Dee\nxfer by Ed\nMastering: Flo": {"recording": "Dee Dee", "transfer": "Ed", "mastering": "Flo"},
    "Mics/recorded by Gus with AKG": {"recording": "Gus"},
    "taped by Schoeps CMC6\ntaped by Hal": {"recording": "Hal"},
    "recorded by mk4\nrecorded by Unknown": {},
    "Transfer: DAT > CD": {},
    "recorded by Ian -> CD; recorded by Jo": {"recording": "Ian"},
    "written by Kit": {},
    "recorded live by Kit": {},
    "by": {},
    "transferred by 1234": {},
    "taped by " + "x" * 41: {},
    "": {},
    None: {},
}


def test_lines(spark):
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "id int, text string, role string").repartition(2)
    got = {i: {} for i in range(len(CASES))}
    for r in credits(table, "id", "text").collect():
        got[r.id][r.role] = r.name
    assert got == dict(enumerate(CASES.values()))
    assert credits(table.limit(0), "id", "text").isEmpty()
