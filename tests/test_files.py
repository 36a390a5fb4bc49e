"""Sections of files of several kinds."""

import zipfile

from inkweave.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def p(text, style=None):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(path):
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('before')}{p('Plan', 'berschrift1')}{p('one')}{p('  ')}{p('two')}{table}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style></w:styles>')


def xlsx(path):
    cells = '<c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c><c r="D1"/>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} xmlns:r="{R}"><sheets><sheet name="Costs" r:id="x1"/><sheet name="None" r:id="x2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>to</t><t>tal</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row r="1">{cells}</row><row r="2"><c r="A2" t="b"><v>1</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {S}><sheetData/></worksheet>")


def test_sections_of_all_kinds(spark, tmp_path):
    docx(tmp_path / "plan.docx")
    xlsx(tmp_path / "Costs.XLSX")
    (tmp_path / "rows.csv").write_text('a,"b, c"\n,\nd,e\n')
    (tmp_path / "note.txt").write_bytes(b"  plain \xff text\n")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "page.md").write_text("intro\n# Top\nbody\n## Sub\nmore\n")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "other.bin").write_bytes(b"x")
    (tmp_path / "_backups").mkdir()
    (tmp_path / "_backups/old.txt").write_text("old")
    (tmp_path / "link.txt").symlink_to(tmp_path / "note.txt")
    found = files.discover(spark, str(tmp_path))
    kinds = {r.path: r.kind for r in found.collect()}
    assert kinds == {"plan.docx": "office", "Costs.XLSX": "office", "rows.csv": "text", "note.txt": "text", "blank.txt": "text", "page.md": "md", "scan.pdf": "pdf", "broken.docx": "office"}
    parts = files.extract(found, str(tmp_path)).cache()
    got = {(r.path, r.heading, r.text) for r in parts.filter("problem is null").collect()}
    assert got == {
        ("plan.docx", None, "before"), ("plan.docx", "Plan", "one\ntwo"), ("plan.docx", "Table 1", "a | b"), ("Costs.XLSX", "Costs", "total |  | 2.5\nTrue | in"),
        ("rows.csv", None, "a | b, c\nd | e"), ("note.txt", None, "plain � text"), ("page.md", None, "intro"), ("page.md", "Top", "body"), ("page.md", "Top > Sub", "more"),
    }
    assert {r.path: r.problem.split(":")[0] for r in parts.filter("problem is not null").collect()} == {"scan.pdf": "no extractor", "broken.docx": "BadZipFile"}
    whole = {r.path: r.text for r in files.flatten(parts).collect()}
    assert whole["plan.docx"] == "before\n\nPlan\none\ntwo\n\nTable 1\na | b" and "scan.pdf" not in whole
    with_pdf = files.extract(found.filter("kind = 'pdf'"), str(tmp_path), {"pdf": lambda raw: [(None, 3, raw.decode())]})
    assert [tuple(r) for r in files.flatten(with_pdf).collect()] == [("scan.pdf", "[page 3] %PDF")]


def test_nothing_found(spark, tmp_path):
    found = files.discover(spark, str(tmp_path))
    assert files.flatten(files.extract(found, str(tmp_path))).count() == 0
