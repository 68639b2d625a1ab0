"""Pictures of made Office files, kept once, and the pages that show them."""

import hashlib
import zipfile
from io import BytesIO

from lexaloom.sources import media

PNG, JPG = b"\x89PNG one", b"\xff\xd8 two"
REL = '<Relationship Id="{}" Type="http://x/relationships/image" Target="{}"/>'


def docx():
    body = '<w:p><wp:docPr id="1" descr="A &amp; B [x]"/><a:blip r:embed="r1"/></w:p><w:p><wp:docPr id="2"/><a:blip r:embed="r2"/><a:blip r:embed="gone"/></w:p>'
    rels = REL.format("r1", "media/a.PNG") + REL.format("r2", "media/b.jpg") + '<Relationship Id="r3" Type="http://x/styles" Target="styles.xml"/>'
    return _zip(
        {"word/document.xml": body, "word/_rels/document.xml.rels": rels, "word/media/a.PNG": PNG, "word/media/b.jpg": JPG}
    )


def _zip(files):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def pptx():
    slide = '<p:pic><p:cNvPr id="4" name="Picture" descr="slide {0}"/><a:blip r:embed="rId2"/></p:pic>'
    files = {f"ppt/slides/slide{k}.xml": slide.format(k) for k in (1, 2, 10)}
    files |= {f"ppt/slides/_rels/slide{k}.xml.rels": REL.format("rId2", "../media/i.png") for k in (1, 10)}
    return _zip(files | {"ppt/media/i.png": PNG})


def odt():
    frame = '<draw:frame><draw:image xlink:href="Pictures/p.png"/><svg:title>T</svg:title></draw:frame>'
    return _zip({"content.xml": frame + frame.replace("p.png", "gone.png"), "Pictures/p.png": JPG})


def test_pictures():
    assert media.pictures("x.docx", docx()) == [(1, "word/media/a.PNG", "A & B [x]", PNG), (1, "word/media/b.jpg", "", JPG)]
    assert media.pictures("x.pptx", pptx()) == [(1, "ppt/media/i.png", "slide 1", PNG), (10, "ppt/media/i.png", "slide 10", PNG)]
    assert media.pictures("x.odt", odt()) == [(1, "Pictures/p.png", "T", JPG)]
    assert media.pictures("x.docx", b"no archive") == [] == media.pictures("x.txt", docx())


def test_tables(spark):
    files = [("in/d.docx", docx()), ("in/p.pptx", pptx()), ("in/o.odt", odt()), ("in/t.txt", b"text"), ("in/n.docx", None)]
    shown = media.shown_media(spark.createDataFrame(files, "path string, content binary").repartition(3)).persist()
    assert shown.count() == 5
    of = {hashlib.sha256(x).hexdigest(): x for x in (PNG, JPG)}
    one, two = hashlib.sha256(PNG).hexdigest(), hashlib.sha256(JPG).hexdigest()
    kept = {r["sha256"]: r for r in media.media_table(shown).collect()}
    assert {s: bytes(r["data"]) for s, r in kept.items()} == of and {s: r["n_files"] for s, r in kept.items()} == {one: 2, two: 2}
    sections = {r["path"]: r["section"] for r in media.image_section(shown).collect()}
    assert sections["in/d.docx"] == f"## Images\n\n![A & B  x ](media/{one[:32]}.png)\n![](media/{two[:32]}.png)\n"
    assert sections["in/p.pptx"].count("### ") == 2 and set(sections) == {"in/d.docx", "in/p.pptx", "in/o.odt"}
    pages = [
        ("a", f"Some text\nbefore ![Alt one](media/{one[:32]}.png) after it ![x](http://else/x.png) and ![ two ](media/{one[:32]}.png \"title\")"), ("b", "no image"), ("c", None), ("d", f"![](media/{two[:32]}.png)" + "y" * 200),
    ]
    df = spark.createDataFrame(pages, "path string, content string")
    got = sorted(tuple(r)[:3] + tuple(r)[4:6] + (r["source"], r["n_files"]) for r in media.image_results(df, shown).collect())
    assert got == [
        ("a", 0, "Alt one", "Some text before", "after it", "in/d.docx", 2), ("a", 2, "two", "and", "", "in/d.docx", 2), ("d", 0, "", "", "y" * 80, "in/d.docx", 2),
    ]
    left = {r["url"]: (r["n_pages"], r["n_places"]) for r in media.references(df.where("path <> 'd'"), shown).collect()}
    assert left == {f"media/{one[:32]}.png": (1, 2), f"media/{two[:32]}.png": (0, 0)}
