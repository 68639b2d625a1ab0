"""Office and OpenDocument files, HTML tables and code, and numbering of communities."""

import io
import zipfile

from lexaloom.operators import graph
from lexaloom.sources import office
from lexaloom.sources import pages as sources

W = 'xmlns:w="urn:w"'


def packed(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_documents():
    run = "<w:r><w:t>{}</w:t></w:r>"
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>' + run.format("Head &amp; all") + "</w:p><w:p><w:pPr><w:numPr/></w:pPr>" + run.format("item") + "</w:p>"
        "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold </w:t></w:r>" + run.format("plain") + "</w:p>"
        "<w:tbl><w:tr><w:tc><w:p>" + run.format("a|b") + "</w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p>" + run.format("2") + "</w:p></w:tc></w:tr></w:tbl>"
    )
    data = packed(word__document=f"<w:document {W}><w:body>{body}</w:body></w:document>")
    assert office.office_text("x.DOCX", data) == "## Head & all\n- item\n**bold** plain\n| a\\|b |  |\n|---|---|\n|  | 2 |"
    assert office.office_text("x.docx", packed(word__document="<w:p><w:t>raw</w:t></w:p><w:p><w:t>words")) == "raw\nwords"
    assert office.office_text("x.docx", b"no archive") == "" and office.office_text("x.docx", packed(other="<a/>")) == ""


def test_sheets_and_slides():
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row><c r="B2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c></row><row/>'
    data = packed(xl__sharedStrings="<sst><si><t>na</t><t>me</t></si></sst>", xl__workbook='<workbook><sheet name="Sums"/></workbook>', xl__worksheets__sheet1=f"<worksheet>{rows}</worksheet>")
    assert office.office_text("b.xlsx", data) == "## Sums\n| name |  | in |\n|---|---|---|\n|  | 1.5 | TRUE |"
    slide = '<s xmlns:a="urn:a"><a:p><a:t>{}</a:t></a:p><a:p/></s>'
    assert office.office_text("c.pptx", packed(ppt__slides__slide10=slide.format("ten"), ppt__slides__slide2=slide.format("two"))) == "## Slide 1\ntwo\n## Slide 2\nten"


def test_open_documents():
    top = '<d xmlns:text="urn:t" xmlns:table="urn:b" xmlns:draw="urn:d"><body>{}</body></d>'
    text = '<text:h text:outline-level="2">Head</text:h><text:p>a <text:span>b</text:span></text:p><text:list><text:list-item><text:p>x</text:p></text:list-item></text:list>'
    assert office.office_text("a.odt", packed(content=top.format(text))) == "## Head\na b\n- x"
    cells = '<table:table-cell table:number-columns-repeated="2"><text:p>7</text:p></table:table-cell><table:table-cell table:number-columns-repeated="16000"/>'
    assert office.office_text("a.ods", packed(content=top.format(f'<table:table table:name="S"><table:table-row>{cells}</table:table-row></table:table>'))) == "## S\n| 7 | 7 |\n|---|---|"
    assert office.office_text("a.odp", packed(content=top.format("<draw:page><text:p>s</text:p></draw:page><draw:page/>"))) == "## Slide 1\ns\n## Slide 2"


def test_html_tables_and_code():
    html = "<p>a <code>x &lt; <b>y</b></code></p><pre><code>if  a:\n    b</code></pre><table><tr><th>H</th><th>I</th></tr><tr><td>1 <b>2</b></td><td><code>c|d</code></td></tr></table>"
    assert sources.markdown_of(html) == "a `x < y`\n\n```\nif  a:\n    b\n```\n\n| H | I |\n|---|---|\n| 1 **2** | `c|d` |"
    assert sources.markdown_of("<table><tr><td>o<table><tr><td>in</td></tr></table></td></tr></table>").count("in") == 1
    assert sources.markdown_of(None) == "" and sources.markdown_of("<table></table>") == ""


def test_numbered_communities(spark):
    sizes = {f"c{k}": 1 + k % 3 for k in range(20)}
    labels = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "community string")
    got = [(r["community"], r["number"], r["size"]) for r in graph.numbered(labels).orderBy("number").collect()]
    assert got == [(c, k, n) for k, (c, n) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], x[0])))]
    assert graph.numbered(labels.limit(0)).count() == 0
