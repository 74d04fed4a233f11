import io
import zipfile

from pyspark.sql import functions as F

from urna.functions.text import text_key
from urna.operators.verify import page_sets
from urna.plans.encodings import workbook_bytes
from urna.sources import archives, catalogue, pages

BASE = "https://elezionistorico.interno.gov.it/index.php"


def zipped(**members):
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/"), content)
    return bytearray(stream.getvalue())


def read(spark, *files, **options):
    df = spark.createDataFrame([(f"f{i}.zip", c) for i, c in enumerate(files)], "path string, content binary")
    return archives.read_archives(df, **options)


def test_delimited_members_and_rejects(spark):
    good = zipped(**{"assemblea.txt": '"CIRCOSCRIZIONE";"COMUNE";"ELETTORI";"LISTA";"VOTI_LISTA"\n"ROMA";"CASSINO";7697;"Città";"1578"\n'.encode("cp1252")})
    unsafe = zipped(**{"../escape.txt": "A;B\n1;2\n"})
    empty = zipped(**{"readme.pdf": "x"})
    rows, rejects = read(spark, good, unsafe, empty, bytearray(b"not a zip"))
    row = rows.collect()[0]
    assert (row["municipality"], row["municipality_key"], row["payload"]["voti_lista"], row["payload"]["lista"], row["row_number"]) == ("CASSINO", "cassino", "1578", "Città", 2)
    errors = {r["path"]: r["error"] for r in rejects.collect()}
    assert errors["f1.zip"].startswith("unsafe path") and set(errors) == {"f1.zip", "f2.zip", "f3.zip"}


def test_size_cap_and_broken_member_reject_the_archive(spark):
    big = zipped(**{"a.txt": "COMUNE;LISTA\n" + "ROMA;A\n" * 500})
    rows, rejects = read(spark, big, max_uncompressed_bytes=100)
    assert rows.count() == 0 and "maximum" in rejects.first()["error"]
    broken = zipped(**{"a.txt": "COMUNE;LISTA;VOTI\nROMA;A;1\n", "b.xlsx": "no workbook"})
    rows, rejects = read(spark, broken)
    assert rows.count() == 0 and rejects.count() == 1


def test_municipality_level_members_only(spark):
    content = zipped(**{"r_LivComune.csv": "COMUNE;LISTA;VOTI\nROMA;A;10\n", "r_LivSez.csv": "COMUNE;SEZIONE;LISTA;VOTI\nROMA;1;A;5\n",
                        "Preferenze_LivComune.csv": "COMUNE;CANDIDATO;P\nROMA;R;3\n"})
    assert [r["file_name"] for r in read(spark, content)[0].collect()] == ["r_LivComune.csv"]
    assert read(spark, content, municipality_level_only=False)[0].count() == 3


def test_headerless_layouts(spark):
    referendum = zipped(**{"referendum-19850609.txt": '"LAZIO";"ROMA";"ROMA";1;"Q";"100";"0";80;0;45;30;5\n'})
    municipal = zipped(**{"comunali-2017.txt": '"LAZIO";"ROMA";"ROMA";100;80;5;"L";"60";4;"ROSSI";"ANNA";"1/1/1970";"ROMA";"F";"S";"60"\n'})
    found = {r["path"]: r for r in read(spark, referendum, municipal)[0].collect()}
    assert found["f0.zip"]["payload"]["numvotisi"] == "45" and found["f0.zip"]["row_number"] == 1
    assert found["f1.zip"]["payload"]["descrlista"] == "L"


def test_delimiters_short_rows_and_blank_first_line(spark):
    content = zipped(**{"a.csv": "comune;lista;voti\nROMA;A;1\nROMA\n\nMILANO;B;2;extra\n", "b.txt": "\ncomune;lista\nROMA;A\n"})
    found = read(spark, content)[0].orderBy("row_number").collect()
    assert [(r["row_number"], r["payload"]) for r in found] == [
        (2, {"comune": "ROMA", "lista": "A", "voti": "1"}), (3, {"comune": "ROMA"}), (5, {"comune": "MILANO", "lista": "B", "voti": "2"})]


def test_sniffed_delimiter(spark):
    content = zipped(**{"a.csv": "comune|lista|voti\n" + "ROMA|A|1\n" * 5})
    assert {r["payload"]["lista"] for r in read(spark, content)[0].collect()} == {"A"}


def test_workbook(spark):
    book = workbook_bytes([("camera", "1994", "LAZIO", "LAZIO 1", "ROMA", "Roma centro", "1", "", "100", "80", "A", "60", "7")])
    row = read(spark, zipped(**{"x.xlsx": book}))[0].first()
    assert (row["file_name"], row["row_number"], row["municipality"]) == ("x.xlsx#Dati", 2, "ROMA")
    assert row["numbers"]["voti_lista"] == 60.0 and row["payload"]["voti_lista"] == "60"


SINGLE = """<html><head><title>Archivio</title><script>var x = "<h3>no</h3>";</script></head><body>
<h3>Benvenuti</h3><div class="testata"><div id="headEnti"><p>x</p><h3>Senato
   21/04/1996 <br> Regione MOLISE <b>Collegio 3</b> <span>Provincia  ISERNIA</span><i></i>Comune AGNONE</h3></div></div>
<table class="riepilogo dati_riepilogo"><tr><th>Elettori</th><td>4.812</td></tr>
<tr><th>Votanti</th><td>3.120</td><td class="percentuale">64,84 %</td></tr><tr><th>Senza valore</th></tr><tr><td>7</td></tr>
<tr><th>Sezioni scrutinate</th><td>9 su 9</td></tr><tr><th>Votanti</th><td>3.121</td></tr></table>
<table summary="Tabella di servizio"><tbody><tr><th>Rumore</th></tr></tbody></table>
<table summary="Prospetto dei RISULTATI"><thead><tr><th class="candidato">Intestazione</th></tr></thead>
<tbody><tr class="leader"><td><img alt="senza"><img src="b.png"></td><th id="candidato7">Rossi  Ada</th><td class="text-left"> </td><td headers="hvoti candidato7">1.001</td>
<td headers="hpercentuale">41,5 %</td></tr>
<tr><td><img src="../simboli/./quercia.png?v=2"></td><th>Riga</th><th class="sx candidato">Quercia</th><td headers="hlista candidato7 hvoti">n.d.</td></tr>
<tr class="totale_liste"><th>Liste</th><td><span id="htotalecoalizione7">Coalizione 7</span></td><td headers="hvoti">950</td></tr>
<tr class="totale_liste"><th>Altre liste</th><td headers="hvoti">10</td><td headers="hseggi">2</td></tr>
<tr><th>Voto disgiunto</th><td headers="hvoti">-3</td></tr><tr><td headers="hvoti">5</td></tr><tr><th> </th><td headers="hvoti">6</td></tr>
<tr class="totalecomplessivovoti"><th>Totale</th><td headers="hvoti">2.415</td></tr></tbody></table></body></html>"""
DOUBLE = """<div id="headEnti"><h3>Comunali 27/05/2007 <i></i> Regione MARCHE<i></i>Comune FANO</h3></div>
<table class="dati_riepilogo"><tr><th>Elettori</th><td>51.300</td><td class="percentuale">x</td><td>51.288</td></tr></table>
<table summary="risultati"><tbody><tr class="leader"><td id="candidato2">Bianchi</td><td class="text-left">Sindaca</td><td headers="hvoti">9.000</td>
<td headers="hvoti2" id="q">14.200</td><td headers="hpercentuale2">53,1</td></tr>
<tr><th class="candidato">Civica</th><td headers="hvoti candidato2">700</td></tr></tbody>
<tfoot><tr><th>Fuori</th></tr></tfoot></table>"""


def parsed(spark, *rows):
    return pages.read_pages(spark.createDataFrame(list(rows), "url string, html string"))


def test_page_of_one_round(spark):
    df = parsed(spark, (f"{BASE}?tpel=S&lev2=5&lev2=31&x=a%20b+c&vuoto=", SINGLE))
    page = df.first()
    assert [page[c] for c in ("regione", "collegio", "provincia", "comune", "area", "election_name", "error")] == ["MOLISE", "3", "ISERNIA", "AGNONE", None, "Senato", None]
    assert (str(page["election_date"]), page["heading_label"], str(page["heading_date"])) == ("1996-04-21", "Senato", "1996-04-21")
    assert page["query_codes"] == {"tpel": "S", "lev2": "31", "x": "a b c", "vuoto": ""}
    # The last line of a label counts.
    assert page["summary"] == {"elettori": 4812, "votanti": 3121} and page["percentages"] == {"votanti_percentuale": 64.84}
    assert page["summary_text"] == {"sezioni_scrutinate": "9 su 9"}
    assert [(r["position"], r["record_type"], r["record_id"], r["parent_id"], r["name"], r["votes"]) for r in page["records"]] == [
        (0, "candidate", "candidato7", "candidato7", "Rossi Ada", 1001),
        (1, "list", None, "candidato7", "Quercia", None),
        (2, "coalition_total", "htotalecoalizione7", None, "Coalizione 7", 950),
        (3, "coalition_total", None, None, "Altre liste", 10),
        (4, "option", None, None, "Voto disgiunto", -3),
        (5, "total", None, None, "Totale", 2415),
    ]
    first, second, *_ = page["records"]
    assert (first["status"], first["percentage"], first["round"], first["symbol_url"]) == (None, 41.5, None, None)
    assert second["symbol_url"] == BASE.rsplit("/", 2)[0] + "/simboli/quercia.png?v=2" or second["symbol_url"].endswith("/simboli/quercia.png?v=2")
    assert page["records"][3]["seats"] == 2 and first["raw_cells"] == ["", "Rossi Ada", "", "1.001", "41,5 %"]
    ready = page_sets(pages.municipality_pages(df)).first()
    assert (ready["category"], ready["college_code"], ready["electors"], ready["place"]) == ("senato", "31", 4812, "p:isernia|agnone")


def test_page_of_two_rounds(spark):
    page = parsed(spark, (f"{BASE}?tpel=G", DOUBLE)).first()
    assert [(r["name"], r["round"], r["votes"], r["percentage"], r["status"]) for r in page["records"]] == [
        ("Bianchi", 1, 9000, None, "Sindaca"), ("Bianchi", 2, 14200, 53.1, "Sindaca"), ("Civica", 1, 700, None, None)]
    assert page["summary"] == {"elettori": 51300, "elettori_turno_2": 51288}


def test_pages_without_records_say_why(spark):
    head = '<div id="headEnti"><h3>{}</h3></div>'
    rows = [
        (f"{BASE}?a", None), (f"{BASE}?b", ""), (f"{BASE}?c", "testo < libero"), (f"{BASE}?d", head.format("")),
        (f"{BASE}?e", head.format("Camera 1996")), (f"{BASE}?f", head.format("Camera 21/04/1996")),
        (f"{BASE}?g", head.format("Camera 21/04/1996") + '<table summary="risultati"><tbody><tr><td>x</td></tr></tbody></table>'),
        (None, head.format("x 99/99/1996")),
    ]
    got = {r["url"]: r for r in parsed(spark, *rows).collect()}
    assert [got[u]["error"] for u, _ in rows] == ["election heading not found"] * 3 + ["unexpected election title"] * 2 + [
        "results table not found", "results table without recognisable rows", "results table not found"]
    assert all(r["records"] is None and r["summary"] is None for r in got.values()) and str(got[f"{BASE}?f"]["heading_date"]) == "1996-04-21"
    assert parsed(spark, *rows).limit(0).count() == 0


def test_selectors_open_the_lowest_new_level(spark):
    html = """<select name="sel_sezione9"><option value="0">Scegli Comune</option><option value="4-lev34">FANO</option><option value="x">-</option>
    <option value="4-lev3b c*~">URBINO</option></select><select name="altro"><option value="1-lev12">NO</option></select>
    <select name="sel_sezione2"><option value="0">SCEGLI PROVINCIA</option><option value="88-lev241">PESARO</option><option value="1-lev07">NO</option></select>
    <select name="sel_sezione1"></select>"""
    first = parsed(spark, (f"{BASE}?tpel=G&tpe=A&lev0=0#top", html)).first()
    assert first["error"] == "election heading not found"
    assert [(c["level"], c["child_url"]) for c in first["children"]] == [(2, f"{BASE}?tpel=G&tpe=P&lev0=0&lev2=41&levsut2=2&ne2=88&es2=S#top")]
    second = parsed(spark, (first["children"][0]["child_url"], html)).first()["children"]
    assert [c["child_url"] for c in second] == [
        f"{BASE}?tpel=G&tpe=C&lev0=0&lev2=41&levsut2=2&ne2=88&es2=S&lev3={v}&levsut3=3&ne3=4&es3=S#top" for v in ("4", "b+c%2A~")]
    assert parsed(spark, (second[0]["child_url"], html)).first()["children"] == []


def test_references_are_resolved_as_a_browser_does(spark):
    from urllib.parse import urljoin

    from urna.functions.urls import resolve_url

    bases = ["https://a.example/x/y/z.php?q=1#f", "https://a.example", "http://a.example/x/"]
    references = ["b.png", "/s/b.png", "../b.png", "../../../b.png", "./c/./d", "c/../d/..", "//h/p", "https://o/p?q", "?z=2", "#top", "", "a/b/../../c?x=../y", "/./a/../b/"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in references], "base string, ref string")
    for b, r, got in rows.select("base", "ref", resolve_url(rows.base, rows.ref)).collect():
        assert got == urljoin(b, r) or (not r and got == b), (b, r)


def test_catalogue(spark):
    html = """var dataSet = [["camera","1948","camera/a.zip","a.zip","18/04/1948","x","19480418",],["senato","19x","b.zip","b.zip","",],["x"],] ;"""
    entries = catalogue.read_catalogue(spark.createDataFrame([(html,)], "html string"))
    rows = entries.orderBy("category").collect()
    assert [(r["category"], r["year"], str(r["election_date"])) for r in rows] == [("camera", 1948, "1948-04-18"), ("senato", None, "None")]
    assert rows[0]["download_url"].endswith("/opendata/camera/a.zip") and rows[0]["identifier"] == "19480418"
    assert catalogue.select_entries(entries, category="camera", year=1948).count() == 1
    assert catalogue.import_candidates(entries, categories=["camera", "senato"]).count() == 1


def test_separator_is_that_of_the_header_record():
    wide = ";".join(f"COLONNA {i}" for i in range(2000))
    assert len(wide) > 8192
    raw = (wide + "\n" + ";".join(f"{i},5" for i in range(2000)) + "\n").encode()
    ((number, payload, _),) = list(archives.delimited_rows(raw, "voti.txt"))
    assert number == 2 and len(payload) == 2000 and payload[text_key("COLONNA 1999")] == "1999,5"
    ((_, payload, _),) = list(archives.delimited_rows(b'"A;B;C;D","E"\n1,2\n', "voti.csv"))
    assert len(payload) == 2


def test_cells_are_clean_when_they_leave_the_reader():
    rows = archives._cells([{"a": " x \t y\x1c"}, None, {}, {"a": None}], archives.pa.string(), archives._clean)
    assert rows.to_pylist() == [[("a", "x y")], None, [], [("a", None)]]
