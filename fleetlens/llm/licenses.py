"""License scan by ordered signature rules (built-in functions only).

A rule is a hand-written pattern with a tier, a keyword gate and a label.  ``LICENSES`` has the names;
each is looked for as an SPDX tag, in a grant ("licensed under ..."), as an
address and as a plain name, and some licenses by a sentence of their text.
The keywords among a text's words are found first, by one split and a hash set; a rule's
pattern runs only on texts that have one of its keywords (a word that its matches hold).  Overlapping
detections are resolved by interval containment: one that lies within a detection of a
better tier, or of its own tier found by an earlier or longer match, is dropped.

Texts stay where they are.  Matches (few) are dealt out by the hash of their text, where places are running sums and containment is a
running maximum for each tier, so work is linear in the matches; equal
texts are scanned alike and reduced to one.  The labels go back by a
join on the hash; a text that many rows share is only a hot key of a plain join.

Base phrases are counted apart from the rules, by words that stand consecutively.

Defined results: null text is empty: no words, no labels, score 0; equal rows all get their labels;
an empty table gives no rows; input columns named like the results are replaced.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import add, any_names, lower_ascii, saved, unused

# words of the text as it is: A-Z belong to them, and patterns ignore the case of ASCII letters
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: fixed values: phrase, label
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_LICENSE, _V = r"licen[cs]es?", r",?\s*\(?(?:version\s*|v\.?\s*)?"
_CC = {"by": "attribution", "by-sa": "attribution-share\\s?alike", "by-nc": "attribution-non\\s?commercial", "by-nd": "attribution-no\\s?deriv(?:ative)?s(?:\\s+works)?",
       "by-nc-sa": "attribution-non\\s?commercial-share\\s?alike", "by-nc-nd": "attribution-non\\s?commercial-no\\s?deriv(?:ative)?s(?:\\s+works)?"}


def _gnu(short: str, long: str, version: str) -> str:
    v = version.replace(".0", r"(?:\.0)?").replace(".", r"\.") if version.endswith(".0") else version.replace(".", r"\.")
    v = v.replace(r"(?:\\.0)?", r"(?:\.0)?")
    return rf"(?:(?:gnu\s+)?{long}(?:\s*\(\s*{short}\s*\))?|gnu\s+{short}|{short}){_V}{v}(?:\s+or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?|\+)?"


def _licenses() -> list[tuple[str, str, str, str]]:
    """Label (SPDX identifier in lower case), name, address, keyword (all as patterns on lower case but the last)."""
    out = []
    for v in ("3.0", "2.0", "1.0"):
        out.append((f"gpl-{v}", _gnu("gpl", rf"general\s+public\s+{_LICENSE}", v), rf"gnu\.org/licenses/(?:old-licenses/)?gpl-{v[0]}(?:\.0)?", "general|gpl*"))
    for v in ("3.0", "2.1", "2.0"):
        out.append((f"lgpl-{v}", _gnu("lgpl", rf"(?:lesser|library)\s+general\s+public\s+{_LICENSE}", v), rf"gnu\.org/licenses/(?:old-licenses/)?lgpl-{re.escape(v)}", "general|lgpl*"))
    for v in ("3.0", "1.0"):
        out.append((f"agpl-{v}", _gnu("agpl", rf"affero\s+general\s+public\s+{_LICENSE}", v), rf"gnu\.org/licenses/agpl-{re.escape(v)}", "affero|agpl*"))
    for v in ("1.3", "1.2", "1.1"):
        out.append((f"gfdl-{v}", _gnu("gfdl", rf"free\s+documentation\s+{_LICENSE}", v), rf"gnu\.org/licenses/(?:old-licenses/)?fdl-{re.escape(v)}", "documentation|gfdl*"))
    out += [("gpl", rf"(?:gnu\s+general\s+public\s+{_LICENSE}|gnu\s+gpl)", r"gnu\.org/licenses/gpl", "general|gpl*"),
            ("lgpl", rf"gnu\s+(?:lesser|library)\s+general\s+public\s+{_LICENSE}|gnu\s+lgpl", r"gnu\.org/licenses/lgpl", "general|lgpl*"),
            ("agpl", rf"(?:gnu\s+)?affero\s+general\s+public\s+{_LICENSE}|gnu\s+agpl", r"gnu\.org/licenses/agpl", "affero|agpl*"),
            ("gfdl", rf"gnu\s+free\s+documentation\s+{_LICENSE}", r"gnu\.org/licenses/fdl", "documentation|gfdl*")]
    for v in ("2.0", "1.1", "1.0"):
        out.append((f"apache-{v}", rf"apache(?:\s+software)?\s+{_LICENSE}{_V}{v[0]}{'(?:[.]0)?' if v == '2.0' else '[.]' + v[2]}", rf"apache\.org/licenses/license-{re.escape(v)}", "apache"))
    out.append(("apache", rf"apache(?:\s+software)?\s+{_LICENSE}", r"apache\.org/licenses", "apache"))
    for v in ("4.0", "3.0", "2.5", "2.0", "1.0"):
        for kind, words in _CC.items():
            spelled = words.replace("-", r"[\s-]+")
            short = kind.replace("-", r"[\s-]")
            out.append((f"cc-{kind}-{v}", rf"(?:cc[\s-]{short}|creative\s+commons[\s:,-]+{spelled}){_V[2:]}[\s-]*{re.escape(v)}|creative\s+commons[\s:,-]+{spelled}(?:\s+\w+){{0,2}}\s+{_LICENSE}{_V}{re.escape(v)}",
                        rf"creativecommons\.org/licenses/{kind}/{re.escape(v)}", "creative|cc|cc0"))
    for kind, words in _CC.items():
        short, spelled = kind.replace("-", r"[\s-]"), words.replace("-", r"[\s-]+")
        out.append((f"cc-{kind}", rf"cc[\s-]{short}(?![\s-]*(?:sa|nc|nd)\b)|creative\s+commons[\s:,-]+{spelled}(?![\s-]+(?:share|non|no)\b)", rf"creativecommons\.org/licenses/{kind}/", "creative|cc|cc0"))
    out.append(("cc0-1.0", r"cc[\s-]?0(?:[\s-]+1\.0)?(?:\s+universal)?|creative\s+commons\s+zero", r"creativecommons\.org/publicdomain/zero", "creative|cc|cc0"))
    for label, name, address, word in (
        ("mit", rf"(?:the\s+)?(?:mit|expat|mit[\s/]+x11)\s+{_LICENSE}", r"opensource\.org/licenses?/mit", "mit|expat"),
        ("mit-0", rf"mit[\s-]+(?:no[\s-]+attribution|0)(?:\s+{_LICENSE})?", r"github\.com/aws/mit-0", "mit"),
        ("isc", rf"isc\s+{_LICENSE}", r"opensource\.org/licenses?/isc", "isc"),
        ("bsd-4-clause", rf"(?:bsd[\s-]4[\s-]clause|(?:4|four)[\s-]clause\s+bsd|original\s+bsd)(?:\s+{_LICENSE})?", r"directory\.fsf\.org/wiki/license:bsd_4clause", "bsd|0bsd|freebsd"),
        ("bsd-3-clause", rf"(?:bsd[\s-]3[\s-]clause|(?:3|three)[\s-]clause\s+bsd|new\s+bsd|modified\s+bsd)(?:\s+{_LICENSE})?", r"opensource\.org/licenses?/bsd-3-clause", "bsd|0bsd|freebsd"),
        ("bsd-2-clause", rf"(?:bsd[\s-]2[\s-]clause|(?:2|two)[\s-]clause\s+bsd|simplified\s+bsd|freebsd)\s+{_LICENSE}", r"opensource\.org/licenses?/bsd-2-clause", "bsd|0bsd|freebsd"),
        ("0bsd", rf"(?:0bsd|zero[\s-]clause\s+bsd|bsd\s+zero\s+clause)(?:\s+{_LICENSE})?", r"opensource\.org/licenses?/0bsd", "bsd|0bsd|freebsd"),
        ("bsd", rf"bsd(?:[\s-]style)?\s+{_LICENSE}", r"opensource\.org/licenses?/bsd-license", "bsd|0bsd|freebsd"),
        ("mpl-2.0", rf"(?:mozilla\s+public\s+{_LICENSE}|mpl){_V}2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0", "mozilla|mpl*"),
        ("mpl-1.1", rf"(?:mozilla\s+public\s+{_LICENSE}|mpl){_V}1\.1", r"mozilla\.org/mpl/mpl-1\.1", "mozilla|mpl*"),
        ("mpl-1.0", rf"(?:mozilla\s+public\s+{_LICENSE}|mpl){_V}1\.0", r"mozilla\.org/mpl/mpl-1\.0", "mozilla|mpl*"),
        ("epl-2.0", rf"(?:eclipse\s+public\s+{_LICENSE}|epl){_V}2\.0", r"eclipse\.org/legal/epl-2\.0", "eclipse|epl*"),
        ("epl-1.0", rf"(?:eclipse\s+public\s+{_LICENSE}|epl){_V}1\.0", r"eclipse\.org/legal/epl-v10", "eclipse|epl*"),
        ("cddl-1.1", rf"(?:common\s+development\s+and\s+distribution\s+{_LICENSE}|cddl)(?:\s*\(cddl\))?{_V}1\.1", r"glassfish\.java\.net/public/cddl\+gpl_1_1", "development|cddl*"),
        ("cddl-1.0", rf"(?:common\s+development\s+and\s+distribution\s+{_LICENSE}|cddl)(?:\s*\(cddl\))?{_V}1\.0", r"opensource\.org/licenses?/cddl-1\.0", "development|cddl*"),
        ("cpl-1.0", rf"common\s+public\s+{_LICENSE}{_V}1\.0", r"ibm\.com/developerworks/library/os-cpl", "common"),
        ("ipl-1.0", rf"ibm\s+public\s+{_LICENSE}{_V}1\.0", r"opensource\.org/licenses?/ipl-1\.0", "ibm"),
        ("unlicense", r"the\s+unlicense|released\s+into\s+the\s+public\s+domain\s+\(unlicense\)", r"unlicense\.org", "unlicense"),
        ("wtfpl", rf"wtfpl|do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+{_LICENSE}", r"wtfpl\.net", "wtfpl|want"),
        ("zlib", rf"zlib(?:/libpng)?\s+{_LICENSE}", r"zlib\.net/zlib_license", "zlib"),
        ("libpng", rf"libpng\s+{_LICENSE}", r"libpng\.org/pub/png/src/libpng-license", "libpng"),
        ("bsl-1.0", rf"boost\s+software\s+{_LICENSE}(?:{_V}1\.0)?", r"boost\.org/license_1_0", "boost"),
        ("artistic-2.0", rf"(?:the\s+)?artistic\s+{_LICENSE}{_V}2\.0", r"opensource\.org/licenses?/artistic-2\.0", "artistic"),
        ("artistic-1.0", rf"(?:the\s+)?artistic\s+{_LICENSE}{_V}1\.0", r"opensource\.org/licenses?/artistic-1\.0", "artistic"),
        ("artistic", rf"(?:the\s+)?artistic\s+{_LICENSE}", r"opensource\.org/licenses?/artistic", "artistic"),
        ("ofl-1.1", rf"(?:sil\s+)?open\s+font\s+{_LICENSE}(?:{_V}1\.1)?", r"scripts\.sil\.org/ofl", "font"),
        ("psf-2.0", rf"(?:python\s+software\s+foundation|psf)\s+{_LICENSE}(?:{_V}2)?", r"docs\.python\.org/[0-9./]*license", "python|psf"),
        ("php-3.01", rf"php\s+{_LICENSE}{_V}3\.01", r"php\.net/license/3_01", "php"),
        ("ruby", rf"ruby(?:'s)?\s+{_LICENSE}", r"ruby-lang\.org/en/about/license", "ruby"),
        ("openssl", rf"openssl\s+{_LICENSE}", r"openssl\.org/source/license", "openssl"),
        ("postgresql", rf"postgresql\s+{_LICENSE}", r"opensource\.org/licenses?/postgresql", "postgresql"),
        ("x11", rf"x11\s+{_LICENSE}", r"xfree86\.org/3\.3\.6/copyright2", "x11"),
        ("ncsa", rf"(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?\s+{_LICENSE}", r"opensource\.org/licenses?/ncsa", "ncsa"),
        ("ms-pl", rf"microsoft\s+public\s+{_LICENSE}|ms[\s-]pl", r"opensource\.org/licenses?/ms-pl", "microsoft|ms"),
        ("ms-rl", rf"microsoft\s+reciprocal\s+{_LICENSE}|ms[\s-]rl", r"opensource\.org/licenses?/ms-rl", "microsoft|ms"),
        ("eupl-1.2", rf"(?:european\s+union\s+public\s+{_LICENSE}|eupl){_V}1\.2", r"joinup\.ec\.europa\.eu/collection/eupl", "european|eupl*"),
        ("eupl-1.1", rf"(?:european\s+union\s+public\s+{_LICENSE}|eupl){_V}1\.1", r"joinup\.ec\.europa\.eu/software/page/eupl", "european|eupl*"),
        ("osl-3.0", rf"open\s+software\s+{_LICENSE}{_V}3\.0", r"opensource\.org/licenses?/osl-3\.0", "software"),
        ("afl-3.0", rf"academic\s+free\s+{_LICENSE}{_V}3\.0", r"opensource\.org/licenses?/afl-3\.0", "academic"),
        ("upl-1.0", rf"universal\s+permissive\s+{_LICENSE}(?:{_V}1\.0)?", r"opensource\.org/licenses?/upl", "universal"),
        ("ecl-2.0", rf"educational\s+community\s+{_LICENSE}{_V}2\.0", r"opensource\.org/licenses?/ecl-2\.0", "educational"),
        ("vim", rf"vim\s+{_LICENSE}", r"vimdoc\.sourceforge\.net/htmldoc/uganda", "vim"),
        ("tcl", rf"tcl/tk\s+{_LICENSE}", r"tcl\.tk/software/tcltk/license", "tcl"),
        ("zpl-2.1", rf"zope\s+public\s+{_LICENSE}{_V}2\.1", r"opensource\.org/licenses?/zpl-2\.1", "zope"),
        ("odbl-1.0", rf"open\s+database\s+{_LICENSE}|odbl", r"opendatacommons\.org/licenses/odbl", "database|odbl"),
        ("pddl-1.0", rf"public\s+domain\s+dedication\s+and\s+{_LICENSE}", r"opendatacommons\.org/licenses/pddl", "domain"),
        ("odc-by-1.0", rf"open\s+data\s+commons\s+attribution\s+{_LICENSE}", r"opendatacommons\.org/licenses/by", "data"),
        ("sspl-1.0", rf"server\s+side\s+public\s+{_LICENSE}", r"mongodb\.com/licensing/server-side-public-license", "server"),
        ("busl-1.1", rf"business\s+source\s+{_LICENSE}(?:{_V}1\.1)?", r"mariadb\.com/bsl11", "business"),
        ("elastic-2.0", rf"elastic\s+{_LICENSE}(?:{_V}2\.0)?", r"elastic\.co/licensing/elastic-license", "elastic"),
        ("commons-clause", r"commons\s+clause(?:\s+license\s+condition)?", r"commonsclause\.com", "commons"),
        ("cecill-2.1", rf"cecill(?:\s+free\s+software)?(?:\s+{_LICENSE})?{_V}2\.1", r"cecill\.info/licences/licence_cecill_v2\.1", "cecill*"),
        ("mulanpsl-2.0", rf"mulan\s+(?:permissive\s+software\s+{_LICENSE}|psl){_V}2", r"license\.coscl\.org\.cn/mulanpsl2", "mulan"),
        ("blueoak-1.0.0", rf"blue\s+oak\s+model\s+{_LICENSE}(?:\s+1\.0\.0)?", r"blueoakcouncil\.org/license/1\.0\.0", "oak"),
        ("public-domain", r"(?:in|into|to)\s+the\s+public\s+domain", r"creativecommons\.org/publicdomain/mark", "domain"),
        ("all-rights-reserved", r"all\s+rights\s+reserved", r"all-rights-reserved", "reserved"),
    ):
        out.append((label, name, address, word))
    return out


LICENSES = _licenses()
#: sentences of license texts
SENTENCES = (
    ("mit", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy", "hereby"),
    ("isc", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose", "permission"),
    ("bsd-3-clause", r"neither\s+the\s+name\s+of\s+.{1,80}?\s+nor\s+the\s+names\s+of\s+its\s+contributors", "neither"),
    ("bsd", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", "redistribution"),
    ("gpl", r"under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+license\s+as\s+published\s+by", "gnu"),
    ("zlib", r"this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty", "warranty"),
    ("bsl-1.0", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization", "hereby"),
    ("unlicense", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", "unencumbered"),
)
#: tier (the smaller, the better), confidence
TIERS = {"tag": (0, 1.0), "sentence": (1, 0.95), "grant": (1, 0.9), "address": (2, 0.85), "name": (3, 0.7)}
BASE_SCORE = 0.6
_BEGIN, _END = "(?<![a-z0-9])", "(?![a-z0-9])"
_GRANT = (r"(?:licen[cs]ed|released|distributed|available|published|provided|redistribute\s+it(?:\s+and/or\s+modify\s+it)?|governed|covered)"
          r"\s+(?:under|with|by)\s+(?:(?:the\s+)?terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+|an?\s+)?(?:")
def rules() -> list[dict]:
    """All rules, in order: of equal detections the first counts."""
    out = []

    def rule(form, label, pattern, word):
        tier, sure = TIERS[form]
        words = []
        for w in word.split("|"):  # name*: also with a version written to it
            words += [w] if w[-1] != "*" else [w[:-1] + v + d for v in ("", "v", "version") for d in ("", *"123")]
        out.append({"n": len(out), "tier": tier, "sure": sure, "label": label, "pattern": "(?i)" + pattern, "keywords": words})

    # one rule for all labels, which are read from the expression that it finds
    rule("tag", None, r"spdx-license-identifier:[ \t(]*+[a-z0-9.+-]++(?:[ \t()]++(?:and|or|with)[ \t(]++[a-z0-9.+-]++)*+", "spdx")
    for label, sentence, word in SENTENCES:
        rule("sentence", label, _BEGIN + sentence, word)
    for label, name, address, word in LICENSES:
        if label not in ("public-domain", "all-rights-reserved"):
            rule("grant", label, _BEGIN + _GRANT + name + ")" + _END, word)
            site = address.replace("\\", "").split("/")[0].split("(")[0]
            rule("address", label, address, site[site.rindex(".") + 1:])
        rule("name", label, _BEGIN + "(?:" + name + ")" + _END, word)
    return out


def _pattern(phrase: str) -> str:
    return rf"(?<!{WORD})" + (GAP + "+").join(phrase.split()) + rf"(?!{WORD})"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+")).cast("bigint")


def _counts(text: Column, lower: Column) -> list[Column]:
    """Places of the base phrases; patterns run only on texts that have a word of one."""
    may = [lower.contains("general"), lower.contains("apache"), lower.contains("cc"), lower.contains("mit")]
    return [F.when(m, F.regexp_count(text, F.lit("(?i)" + _pattern(p)))).otherwise(0).cast("bigint") for m, (p, _) in zip(may, BASE)]


def _base(text: Column, counts: list[Column]) -> dict[str, Column]:
    """The other base columns, of the places counted."""
    total = counts[0] + counts[1] + counts[2] + counts[3]
    any_phrase = "(?:" + "|".join(_pattern(p) for p, _ in BASE) + ")"
    before = F.regexp_extract(text, "(?is)^(.*?)" + any_phrase, 1)
    before_last = F.regexp_extract(text, "(?is)^(.*)" + any_phrase, 1)
    labels = F.array_sort(F.filter(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(counts, BASE)]), lambda x: x.isNotNull()))
    return {"n_base": total, "first_word": F.when(total > 0, n_words(before)),
            "last_word": F.when(total > 0, n_words(before_last)), "base_labels": labels}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def detections(docs: DataFrame, text: str) -> DataFrame:
    """``x, y, label, n, sure, start, end``: for the hash of each text, what the rules find and containment leaves.

    ``start`` and ``end`` are code points."""
    x, y = _keys(F.col(text))
    own = docs.select(x.alias("x"), y.alias("y"), F.col(text).alias("text"))
    table = rules()
    keywords = F.from_json(F.lit(json.dumps(sorted({k for r in table for k in r["keywords"]}))), "array<string>")
    table = F.from_json(F.lit(json.dumps(table)), "array<struct<n:int,tier:int,sure:double,label:string,pattern:string,keywords:array<string>>>")
    has = F.array_intersect(F.split(lower_ascii(F.col("text")), "[^a-z0-9]+"), keywords)
    tags = F.from_json(F.lit(json.dumps([x[0] for x in LICENSES])), "array<string>")
    fit = _let(has, lambda h: F.when(F.size(h) > 0, F.filter(table, lambda r: F.arrays_overlap(h, r["keywords"]))))
    body = F.col("text")

    def tagged(expression):
        ids = F.split(lower_ascii(expression), r"[\s():]+")
        return F.array_intersect(F.transform(ids, lambda i: F.regexp_replace(i, r"(?:-only|-or-later|\+)?[.]*$", "")), tags)

    def matches(r):
        gaps = F.transform(F.split(body, r["pattern"], -1), F.length)
        texts = F.regexp_extract_all(body, r["pattern"], F.lit(0))
        own = F.transform(texts, lambda t: F.struct(F.length(t).alias("size"), F.when(r["label"].isNull(), tagged(t)).otherwise(F.array(r["label"])).alias("labels")))
        rows = F.filter(F.arrays_zip(gaps.alias("gap"), own.alias("own")), lambda m: m["own"].isNotNull())
        return F.transform(rows, lambda m, i: F.struct(r["n"].alias("n"), r["tier"].alias("tier"), r["sure"].alias("sure"),
                                                       m["own"]["labels"].alias("labels"), i.alias("i"), m["gap"].alias("gap"), m["own"]["size"].alias("size")))

    rows = own.select("x", "y", F.explode(F.flatten(F.transform(fit, matches))).alias("m")).select("x", "y", "m.*") \
        .dropDuplicates(["x", "y", "n", "i"])
    rows = rows.repartition("x", "y")
    at = Window.partitionBy("x", "y", "n").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(at)).withColumn("start", F.col("end") - F.col("size"))
    earlier = Window.partitionBy("x", "y").orderBy("start", F.desc("end"), "tier", "n").rowsBetween(Window.unboundedPreceding, -1)
    tiers = sorted({t for t, _ in TIERS.values()})
    rows = rows.select("*", *[F.max(F.when(F.col("tier") == t, F.col("end"))).over(earlier).alias(f"end{t}") for t in tiers])
    inside = F.lit(False)
    for t in tiers:
        inside = inside | (F.lit(t) <= F.col("tier")) & F.coalesce(F.col(f"end{t}") >= F.col("end"), F.lit(False))
    return rows.where(~inside).select("x", "y", F.explode("labels").alias("label"), "n", "sure", "start", "end")


def _keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


@any_names
def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` (arrays), ``found`` (array of start, end, label: what the rules found) and ``score``."""
    a, b, found, fx, fy, sure = unused(docs, "x", "y", "found", "fx", "fy", "sure")
    x, y = _keys(docs[text])
    t, low, *counts = unused(docs, "text", "lower", *[f"count{i}" for i in range(len(BASE))])
    own = docs.withColumns({a: x, b: y, t: F.coalesce(docs[text], F.lit("")), low: lower_ascii(F.coalesce(docs[text], F.lit("")))})
    # in a select of their own, so that each is computed once
    own = own.withColumns(dict(zip(counts, _counts(F.col(t), F.col(low)))))
    own = add(own, n_words=n_words(F.col(t)), **_base(F.col(t), [F.col(c) for c in counts]))
    own = own.select(*dict.fromkeys([*(docs.columns if keep is None else keep), "n_words", "n_base", "first_word", "last_word", "base_labels", a, b]))
    by_text = detections(docs, text).groupBy(F.col("x").alias(fx), F.col("y").alias(fy)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias(found), F.max("sure").alias(sure))
    by_text = saved(by_text)  # kept apart, so that both sides are dealt out for the join and a common text's rows can be split
    out = own.join(by_text, (own[a] == by_text[fx]) & (own[b] == by_text[fy]), "left")
    listed = F.coalesce(F.col(found), F.array().cast("array<struct<start:bigint,end:bigint,label:string>>"))
    labels = F.array_sort(F.array_union("base_labels", F.transform(listed, lambda d: d["label"])))
    score = F.greatest(F.coalesce(F.col(sure), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return add(out, labels=labels, found=listed, score=score).drop(a, b, fx, fy, sure, found)
