"""Usual forms of known licences: titles, holders without a year or on a line of their own, a wrapped phrase."""

import duckdb
import pytest

from waymark.llm import licenses

MIT = licenses.TEXTS["MIT"]
WRAPPED = MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS").replace("The above copyright notice", "The above\ncopyright notice")
KNOWN = [
    f"The MIT License (MIT)\n\nCopyright (c) 2020 Foo\n\n{MIT}",
    f"MIT License\n\nCopyright Foo Inc.\n\n{MIT}",
    f"MIT License\n\nCopyright The X Authors 2020\n\n{MIT}",
    f"MIT License\n\nCopyright (c) 2020\nFoo Bar and others\n\n{MIT}",
    f"MIT License\n\nCopyright (c) 2020 Foo. All rights\nreserved.\n\n{MIT}",
    f"Copyright 2019, 2020\r\n  Foo\r\n\r\n{MIT}",
    f"# The MIT License\n\n© 2020 Foo\nCopyright: Bar Ltd\n\n{WRAPPED}",
    f"All rights reserved. All rights\nreserved.\n{MIT}",
]
OTHERS = [f"MIT License\n\nCopyright (c) 2020\nThis line has too many words to be a holder's\n\n{MIT}", MIT.replace("free of charge", "at a charge"), "copyright", "Copyright (c) 2020\nFoo", "copyright " * 2000, "a" * 50_000, f"Copyright holders agree\n{MIT}"]


def test_forms_are_known_in_both_engines(spark):
    texts = [*KNOWN, *OTHERS, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs).filter("scope = 'text'").collect()))
    assert got == [(k, "text", 0, "MIT") for k in range(len(KNOWN))]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [[k, t] for k, t in enumerate(texts)])
    assert sorted(r for r in c.sql(licenses.duckdb_sql()).fetchall() if r[1] == "text") == got


@pytest.mark.parametrize("name", ["Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0", "Artistic"])
def test_long_texts_keep_their_digests(name):
    import hashlib
    from pathlib import Path

    path = Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("no licence texts here")
    digest = hashlib.md5(licenses.canonical(path.read_text(encoding="utf-8", errors="replace")).encode()).hexdigest()
    assert name in licenses.known_digests()[digest] or name.split("-")[0] in licenses.known_digests()[digest]
