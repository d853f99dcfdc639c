"""Course trees: hand-computed passages and units."""

import hashlib

from lodestone.sources.courses import read_latex_course, read_xml_course

TEX = r"""Intro \textbf{bold \emph{deep} end} text. % gone
Kept 5\% here \cite{x}.

Second \ref{a} paragraph $x$.
\begin{defn}
A \emph{set} is a thing.

\begin{proof}
Trivial.
\end{proof}
After the proof.
\end{defn}
\begin{empty}
\end{empty}
Last.
"""


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()[:16]


def test_latex(spark, tmp_path):
    (tmp_path / "a b+c").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "a b+c" / "one.tex").write_text(TEX)
    (tmp_path / "a b+c" / "none.tex").write_text("")
    (tmp_path / "build" / "two.tex").write_text("Left out.")
    passages, units = read_latex_course(spark, str(tmp_path))
    got = [(r["text"], r["unit_id"]) for r in passages.orderBy("seq").collect()]
    u = "olp_unit:a b+c/one.tex:"
    assert got == [
        ("Intro bold deep end text. Kept 5\\% here .", None),
        ("Second paragraph x .", None),
        ("A set is a thing.", u + "defn:1"),
        ("Trivial.", u + "proof:1"),
        ("After the proof.", u + "defn:1"),
        ("Last.", None),
    ]
    ids = {r["text"]: r["passage_id"] for r in passages.collect()}
    assert ids["Trivial."] == "olp:" + sha(f"a b+c/one.tex::{u}proof:1::0::Trivial.")
    assert ids["Second paragraph x ."] == "olp:" + sha("a b+c/one.tex::none::1::Second paragraph x .")
    assert {r["unit_id"]: (r["unit_type"], r["text"]) for r in units.collect()} == {
        u + "defn:1": ("defn", "A set is a thing.\nAfter the proof."),
        u + "proof:1": ("proof", "Trivial."),
        u + "empty:1": ("empty", ""),
    }


MODULE = """<document xmlns="http://cnx.rice.edu/cnxml"><title>Motion</title><content>
<para id="p1">First <emphasis>words</emphasis>  here.</para>
<section><title>Speed</title><para>No id.</para>
<example id="e1"><para id="p2">An example paragraph that is long enough to count.</para></example>
<equation>v</equation><equation>w</equation></section><para id="p3"> </para></content></document>"""
COLLECTION = """<col:collection xmlns:col="http://cnx.rice.edu/collxml" xmlns:md="http://cnx.rice.edu/mdml"><col:metadata><md:title>Volume 1</md:title></col:metadata>
<col:content><col:subcollection><md:title>Unit</md:title><col:content><col:module document="m1"/></col:content></col:subcollection></col:content></col:collection>"""


def test_xml(spark, tmp_path):
    for m in ("m1", "m2"):
        (tmp_path / "modules" / m).mkdir(parents=True)
        (tmp_path / "modules" / m / "index.cnxml").write_text(MODULE)
    (tmp_path / "collections").mkdir()
    (tmp_path / "collections" / "v.collection.xml").write_text(COLLECTION)
    passages, units = read_xml_course(spark, str(tmp_path))
    long = "An example paragraph that is long enough to count."
    got = [tuple(r) for r in passages.where("doc_id = 'm1'").orderBy("seq").select("passage_id", "section", "text", "unit_id").collect()]
    assert got == [
        ("osp:m1:p1", "Volume 1 / Motion", "First words here.", None),
        ("osp:m1:" + sha("m1::No id."), "Volume 1 / Motion / Speed", "No id.", None),
        ("osp_passage_unit:osp_unit:m1:example:e1", "Volume 1 / Motion / Speed", long, "osp_unit:m1:example:e1"),
        ("osp:m1:p2", "Volume 1 / Motion / Speed", long, "osp_unit:m1:example:e1"),
    ]
    assert {(r["unit_id"], r["text"]) for r in units.where("doc_id = 'm1'").collect()} == {("osp_unit:m1:example:e1", long), ("osp_unit:m1:equation:1", "v"), ("osp_unit:m1:equation:2", "w")}
    assert passages.where("doc_id = 'm2' AND section LIKE 'OpenStax University Physics / Motion%'").count() == 4
