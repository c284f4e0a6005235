"""Operator 8: licence scans by sentence rules.

Wrapped lines are joined, comment marks left out, and texts are cut into sentences at
stops, at blank lines, and where a line begins what may stand alone. Each is normalised
(lower case, runs of anything else than letters and digits to one space), known
sentences are mapped to identifiers by what they begin with, versions included, and
the sequence of a document's identifiers is matched against ordered licence rules. A
rule that matches takes its identifiers out of the sequence, so a longer rule tried
first keeps its parts from matching a shorter one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNDER = r"^(this (work|program|library|software|project|file) is )?(licensed|released|distributed) under (the )?(terms of the )?"
_AGAIN = r"^this (program|library|software) is free software you can redistribute it and or modify it under the terms of the "

#: Licences that files name by their identifier.
TAGGED = (
    "MIT", "MIT-0", "Apache-2.0", "Apache-1.1", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC",
    "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "WTFPL", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Artistic-1.0", "Artistic-2.0", "GFDL-1.2", "GFDL-1.3", "PSF-2.0", "OFL-1.1",
)


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


#: Identifier and normalised beginning of known licence sentences, first match wins.
SENTENCES = (
    *((f"spdx{re.sub('[^A-Za-z0-9]', '', name)}", f"^spdx license identifier {normal(name)}( |$)") for name in sorted(TAGGED, key=len, reverse=True)),
    ("spdx", r"^spdx license identifier .+"),
    ("boostGrant", r"^permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mitGrant", r"^permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mitNotice", r"^the above copyright notice and this permission notice shall be included in all copies"),
    ("mitWarranty", r"^the software is provided as is without warranty of any kind"),
    ("iscGrant", r"^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"),
    ("zeroGrant", r"^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlibWarranty", r"^this software is provided as is without any express or implied warranty"),
    ("zlibGrant", r"^permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsdGrant", r"^redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsdSource", r"^(1 )?redistributions of source code must retain the above copyright notice"),
    ("bsdBinary", r"^(2 )?redistributions in binary form must reproduce the above copyright notice"),
    ("bsdAdvertising", r"^(3 )?all advertising materials mentioning features or use of this software must display"),
    ("bsdNames", r"^([34] )?neither the names? of .+ may be used to endorse or promote products"),
    ("bsdWarranty", r"^this software is provided by .+"),
    ("agpl3Free", _AGAIN + r"gnu affero general public license .+ version 3"),
    ("lgpl3Free", _AGAIN + r"gnu lesser general public license .+ version 3"),
    ("lgpl21Free", _AGAIN + r"gnu lesser general public license .+ version 2 1"),
    ("gpl3Free", _AGAIN + r"gnu general public license .+ version 3"),
    ("gpl2Free", _AGAIN + r"gnu general public license .+ version 2"),
    ("gplFree", _AGAIN + r"gnu general public license"),
    ("lgpl3Ref", _UNDER + r"gnu lesser general public license (version |v )?3"),
    ("lgpl21Ref", _UNDER + r"gnu lesser general public license (version |v )?2 1"),
    ("lgplRef", _UNDER + r"gnu lesser general public license"),
    ("agpl3Ref", _UNDER + r"gnu affero general public license (version |v )?3"),
    ("agplRef", _UNDER + r"gnu affero general public license"),
    ("gpl3Ref", _UNDER + r"gnu general public license (version |v )?3"),
    ("gpl2Ref", _UNDER + r"gnu general public license (version |v )?2"),
    ("gplRef", _UNDER + r"gnu general public license"),
    ("apache2Ref", _UNDER + r"apache license (version |v )?2 0"),
    ("apacheRef", _UNDER + r"apache license"),
    ("apacheObtain", r"^you may obtain a copy of the license at"),
    ("mitRef", _UNDER + r"mit license"),
    ("bsdRef", _UNDER + r"(a )?bsd"),
    ("mpl2Ref", r"^(this .+ )?(is )?subject to the terms of the mozilla public license (version |v )?2 0"),
    ("mplRef", r"^(this .+ )?(is )?subject to the terms of the mozilla public license"),
    ("epl2Ref", r"^this program and the accompanying materials are made available under the terms of the eclipse public license (version |v )?2 0"),
    ("eplRef", r"^this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc0Ref", r"^(this (work|program|software) is )?(licensed|released|dedicated) (under|with|to) (the )?(cc0|creative commons zero|public domain under cc0)"),
    ("ccByNc4Ref", _UNDER + r"(a )?(cc by nc|creative commons attribution non ?commercial)( international)? 4 0"),
    ("ccByNcRef", _UNDER + r"(a )?(cc by nc( |$)|creative commons attribution non ?commercial)"),
    ("ccBySa4Ref", _UNDER + r"(a )?(cc by sa|creative commons attribution share ?alike)( international)? 4 0"),
    ("ccBySaRef", _UNDER + r"(a )?(cc by sa( |$)|creative commons attribution share ?alike)"),
    ("ccBy4Ref", _UNDER + r"(a )?(cc by|creative commons attribution)( international)? 4 0"),
    ("ccByRef", _UNDER + r"(a )?(cc by( |$)|creative commons attribution)"),
    ("unlicense", r"^this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"^(0 )?you just do what the fuck you want to"),
    ("lgpl3Title", r"^gnu lesser general public license version 3 29 june 2007"),
    ("lgpl2Title", r"^gnu library general public license version 2 june 1991"),
    ("gpl1Title", r"^gnu general public license version 1 february 1989"),
    ("gfdl12Title", r"^gnu free documentation license version 1 2 november 2002"),
    ("gfdl13Title", r"^gnu free documentation license version 1 3 3 november 2008"),
    ("mpl11Title", r"^mozilla public license version 1 1"),
    ("artisticTitle", r"^the artistic license$"),
    ("artistic2Title", r"^(the )?artistic license 2 0"),
    ("cc0Title", r"^(creative commons legal code )?cc0 1 0 universal"),
    ("copyright", r"^copyright (c )?[0-9]{4}"),
    ("reserved", r"^all rights reserved"),
)

#: Licence and the identifiers that must stand together in this order; tried from the top.
RULES = (
    ("BSD-4-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdAdvertising", "bsdNames", "bsdWarranty")),
    ("BSD-3-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdNames", "bsdWarranty")),
    ("BSD-2-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdWarranty")),
    ("MIT", ("mitGrant", "mitNotice", "mitWarranty")),
    ("BSL-1.0", ("boostGrant",)),
    ("Zlib", ("zlibWarranty", "zlibGrant")),
    ("Apache-2.0", ("apache2Ref", "apacheObtain")),
    ("ISC", ("iscGrant",)),
    ("0BSD", ("zeroGrant",)),
    ("AGPL-3.0", ("agpl3Free",)),
    ("LGPL-3.0", ("lgpl3Free",)),
    ("LGPL-2.1", ("lgpl21Free",)),
    ("GPL-3.0", ("gpl3Free",)),
    ("GPL-2.0", ("gpl2Free",)),
    ("GPL", ("gplFree",)),
    ("AGPL-3.0", ("agpl3Ref",)),
    ("AGPL", ("agplRef",)),
    ("LGPL-3.0", ("lgpl3Ref",)),
    ("LGPL-2.1", ("lgpl21Ref",)),
    ("LGPL", ("lgplRef",)),
    ("GPL-3.0", ("gpl3Ref",)),
    ("GPL-2.0", ("gpl2Ref",)),
    ("GPL", ("gplRef",)),
    ("Apache-2.0", ("apache2Ref",)),
    ("Apache", ("apacheRef",)),
    ("MIT", ("mitRef",)),
    ("BSD", ("bsdRef",)),
    ("MPL-2.0", ("mpl2Ref",)),
    ("MPL", ("mplRef",)),
    ("EPL-2.0", ("epl2Ref",)),
    ("EPL", ("eplRef",)),
    ("CC0-1.0", ("cc0Ref",)),
    ("CC-BY-NC-4.0", ("ccByNc4Ref",)),
    ("CC-BY-NC", ("ccByNcRef",)),
    ("CC-BY-SA-4.0", ("ccBySa4Ref",)),
    ("CC-BY-SA", ("ccBySaRef",)),
    ("CC-BY-4.0", ("ccBy4Ref",)),
    ("CC-BY", ("ccByRef",)),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    *((name, (f"spdx{re.sub('[^A-Za-z0-9]', '', name)}",)) for name in TAGGED),
    ("LGPL-3.0", ("lgpl3Title",)),
    ("LGPL-2.0", ("lgpl2Title",)),
    ("GPL-1.0", ("gpl1Title",)),
    ("GFDL-1.2", ("gfdl12Title",)),
    ("GFDL-1.3", ("gfdl13Title",)),
    ("MPL-1.1", ("mpl11Title",)),
    ("Artistic-1.0", ("artisticTitle",)),
    ("Artistic-2.0", ("artistic2Title",)),
    ("CC0-1.0", ("cc0Title",)),
    ("SPDX", ("spdx",)),
    ("Proprietary", ("copyright", "reserved")),
)

#: A text, or a piece of it, without any of these has no known sentence.
HINT = r"licen[sc]e|permission|redistribution|software is provided|neither the name|advertising materials|copyright|all rights reserved|cc0|cc by|creative commons|public domain|do what the"


def wrapped(pattern: str) -> str:
    """A beginning of a sentence, as it stands at a line's start; words may stand on several lines."""
    return pattern.removeprefix("^").replace("identifier .+", r"identifier [^\n]+").replace(".+", r"[\s\S]+?").replace(" ", r"[ \n]")


#: Known sentences at a line's start, first match wins.
_AT = "(?m)^(?=(" + "|".join(wrapped(p) for _, p in SENTENCES) + "))"


def sentences(text: Column) -> Column:
    """Normalised sentences: pieces between blank lines, or after . ! ? and white space.

    A line feed stands where a line or a part after a semicolon begins. A line is
    blank without letters and digits, so comment marks go with the other signs. The
    stop of "v." ends nothing.
    """
    stops = F.regexp_replace(F.regexp_replace(text, r"\b([vV])\. ", "$1 "), r"[.!?][ \t\r\n]+", "\n\n")
    ends = F.regexp_replace(stops, r";[ \t\r]++(?!\n)", "\n")
    plain = F.regexp_replace(F.lower(ends), r"[^\p{L}\p{N}\n]+", " ")
    pieces = F.split(F.regexp_replace(plain, r"(?m)^ ?(?:dnl|rem)(?: |$)", ""), r"\n[ \n]*\n")
    return F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, r" ?\n ?", "\n"), F.lit(" \n")))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence is known from its own start or from that of one of its lines, and read
    on over line feeds, so wrapped lines are joined and lines that stand alone count.
    """

    def name(s: Column) -> Column:
        return reduce(lambda rest, rule: F.when(s.rlike(rule[1]), F.lit(rule[0])).otherwise(rest), reversed(SENTENCES), F.lit(None).cast("string"))

    hinted = F.filter(sentences(text), lambda s: F.concat_ws("", F.lit(""), s).rlike(HINT.replace(" ", r"[ \n]")))

    def known(s: Column) -> Column:
        found = F.regexp_extract_all(s, F.lit(_AT), F.lit(1))
        # "is licensed under" on two lines would be found from both.
        before = F.concat(F.array(F.lit("")), found)
        return F.filter(found, lambda x, i: ~F.endswith(F.get(before, i), F.concat(F.lit("\n"), x)))

    found = F.transform(F.flatten(F.transform(hinted, known)), lambda s: name(F.translate(s, "\n", " ")))
    return F.when(text.rlike("(?i)" + HINT.replace(" ", r"\W+")), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones, long), sentence_ids and licences (comma-joined).

    Licences come in rule order, each once; ``unmatched`` holds identifiers that no
    rule took. Null and empty texts have none of them: 0 and empty strings. Long
    texts are read whole; repeated rows and null doc_ids are kept as rows, other
    columns ignored; an empty table gives no rows. No shuffle is needed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", F.array_join(identifiers(text), ",").alias("sentence_ids"))
    # Every identifier stands between commas of its own, so that a rule is a substring.
    out = found.withColumn("rest", F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(",")))
    # Each step keeps (rest, licences) in one struct, so no expression is doubled.
    state = F.struct(F.col("rest"), F.lit("").alias("licences"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in ids)).alias("ids")) for name, ids in RULES))

    def step(acc: Column, rule: Column) -> Column:
        there = F.contains(acc["rest"], rule["ids"])
        fresh = ~F.contains(F.concat(F.lit(","), acc["licences"], F.lit(",")), F.concat(F.lit(","), rule["name"], F.lit(",")))
        longer = F.concat(acc["licences"], F.when(acc["licences"] == "", F.lit("")).otherwise(F.lit(",")), rule["name"])
        return F.struct(F.when(there, F.replace(acc["rest"], rule["ids"], F.lit(""))).otherwise(acc["rest"]).alias("rest"), F.when(there & fresh, longer).otherwise(acc["licences"]).alias("licences"))

    out = out.withColumn("state", F.when(F.col("sentence_ids") == "", state).otherwise(F.aggregate(rules, state, step)))
    return out.select(
        "doc_id", F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", ","))).cast("long").alias("n_sentences"), "sentence_ids",
        F.col("state.licences").alias("licences"), F.trim(F.replace("state.rest", F.lit(",,"), F.lit(",")), F.lit(",")).alias("unmatched"),
    )
