"""Document formats, each from a file made here."""

import io
import zipfile

from quillfold.sources import formats


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x").replace("_o", ".o"), text)
    return out.getvalue()


def test_each_kind(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    files = {
        "a.txt": "caf\u00e9".encode(),
        "b.TXT": b"\xef\xbb\xbfmark",
        "c.txt": b"caf\xe9 \x81",
        "d.md": b"# Head\n\n* one **two** [three](http://x.example)\n> quote_d _it_\n```py\ncode\n```\n---\n1. last",
        "e.html": b"<p>One &amp; two</p><script>no()</script><div>three<br>four</div><!-- x -->",
        "f.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x}\uc1 Hello \b bold\b0\par caf\'e9 \u8364?5\tab end}",
        "g.eml": b"From: a@b.example\r\nTo: c@d.example\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Body <b>here</b></p>",
        "h.vcf": b"BEGIN:VCARD\r\nVERSION:3.0\r\nFN:Ann\r\n  Other\r\nTEL;TYPE=home:1\r\nNOTE:a\\, b\r\nEND:VCARD\r\n",
        "i.docx": zipped(word__document_xml=f"<w:document {w}><w:p><w:r><w:t>One</w:t><w:tab/><w:t> two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p></w:document>"),
        "j.odt": zipped(content_xml='<o xmlns:t="urn:t"><t:h>Head</t:h><t:p>Body <t:span>text</t:span></t:p></o>'),
        "k.epub": zipped(c_opf='<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>', a_xhtml="<p>first</p>", b_xhtml="<p>second</p>"),
        "l.xlsx": zipped(xl__sharedStrings_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml='<s><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></s>'),
        "m.pptx": zipped(ppt__slides__slide2_xml='<s xmlns:a="u"><a:p><a:t>two</a:t></a:p></s>', ppt__slides__slide1_xml='<s xmlns:a="u"><a:p><a:t>one</a:t></a:p></s>'),
        "n.docx": b"no archive",
        "o.docx": zipped(word__document_xml='<!DOCTYPE x [<!ENTITY e "x">]><d>&e;</d>'),
        "p.bin": b"skipped",
        "q.ics": b"nothing",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in formats.read_documents(spark, str(tmp_path)).collect()}
    text = {k: r.text for k, r in rows.items()}
    assert "p.bin" not in rows and {k for k, r in rows.items() if r.error} == {"n.docx", "o.docx", "q.ics"} == {k for k, t in text.items() if t is None}
    assert (text["a.txt"], text["b.TXT"], text["c.txt"]) == ("caf\u00e9", "mark", "caf\u00e9 \x81")
    assert text["d.md"].split("\n")[0] == "Head" and "one two three" in text["d.md"] and "quote_d it" in text["d.md"] and text["d.md"].endswith("last") and "---" not in text["d.md"]
    assert text["e.html"] == "One & two\nthree\nfour"
    assert text["f.rtf"] == "Hello bold\ncaf\u00e9 \u20ac5 end"
    assert text["g.eml"] == "From: a@b.example\nTo: c@d.example\nSubject: caf\u00e9\n\nBody here"
    assert text["h.vcf"] == "FN: Ann Other\nTEL: 1\nNOTE: a, b"
    assert text["i.docx"] == "One two\nthree" and text["j.odt"] == "Head\nBody text" and text["k.epub"] == "first\nsecond"
    assert text["l.xlsx"] == "name\t5\nin" and text["m.pptx"] == "one\ntwo"
    files = spark.createDataFrame([(None, b"x"), ("x.md", None), ("y", b"z")], "path string, content binary")
    assert [r.text for r in formats.parsed(files).collect()] == [None, None, None] and formats.parsed(files.limit(0)).count() == 0
