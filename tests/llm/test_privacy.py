"""Personal data on sentences that no labeler, word list or threshold was written from."""

import pytest
from pyspark.sql import functions as F

from shardleaf.llm import privacy

HELD_OUT = [
    ("our client Dmitri Volkov complained about the invoice twice", "name"), ("I spoke with Bronisław Achterberg on Monday about the outage", "name"), ("Could you forward this to Mrs Halloran before noon?", "name"),
    ("Reported-by: Tomasina Quell", "name"), ("The patch was reviewed by Eleanor Whitcombe and merged", "name"), ("Dear Mr. Abernathy, the export is attached", "name"), ("Author: Gethin Pryce", "name"),
    ("please ask Rosalind Akintola for access", "name"), ("this ticket belongs to Dr. Lindqvist", "name"), ("Hi Marguerite, the dashboard is back up", "name"), ("thanks, Oluwaseun Adeyemi", "name"), ("met Haruka Nishimura at the review", "name"),
    ("customer Leopold Fairweather wants a refund", "name"), ("Signed-off-by: Yevgenia Morozova", "name"), ("cc: Prof. Castellanos", "name"), ("my name is Thaddeus Birchall and I run support", "name"),
    ("write to petra.voss@kontor-nord.de for the keys", "email"), ("the account holder is j_okafor77@webmail.example.org", "email"), ("Contact: help.me.jane+bugs@uni-west.edu", "email"), ("mailto:karl-heinz@example.net", "email"),
    ("bounced mail for s.lebrun@orange-exemple.fr again", "email"), ("reply to annika [at] northwind [dot] se please", "email"), ("from tkaminski at poczta dot example dot pl", "email"), ("the user list has bella%40mailhost.example in it", "email"), ("notify ops@northwind.example and wait", "email"),
    ("invite r.delgado@empresa.example to the board", "email"), ("git config user.email wanda.b@example.org", "email"), ("his address lukas@tuebingen.example is dead", "email"),
    ("call me at +49 151 2345 6789 after six", "phone"), ("phone: (312) 555-0147", "phone"), ("my mobile is 07700 900482", "phone"), ("fax 020 7946 0991 is gone", "phone"), ("Tel. +33 6 12 34 56 78", "phone"), ("text 415-555-0132 when it is done", "phone"),
    ("reach her on 0044 20 7946 0123", "phone"), ("the on-call number is 1-800-555-0175 ext. 12", "phone"), ("dial +1 (646) 555-0190 now", "phone"), ("WhatsApp +34 612 345 678", "phone"), ("ring 555-0163 and ask", "phone"),
    ("my passport number is C01X00T47", "id_number"), ("his CPF is 529.982.247-25", "id_number"), ("Aadhaar 2345 6789 0124 was in the dump", "id_number"), ("the driver licence MORGA753116SM9IJ was scanned", "id_number"), ("SSN 219-09-9999 must be masked", "id_number"),
    ("NI number QQ 12 34 56 C stands in row two", "id_number"), ("her social insurance number 046 454 286 leaked", "id_number"), ("NIE X-1234567-L", "id_number"), ("Personnummer 811228-9874", "id_number"), ("passport no. 925665416", "id_number"), ("tax ID 12 345 678 901", "id_number"), ("codice fiscale RSSMRA85T10A562S", "id_number"),
    ("we moved to 48 Larkspur Avenue, Dunmore", "address"), ("ship it to 1200 West Elm Street, Apt 5B, Fairview, CA 90210", "address"), ("she lives at 7 Abbey Road, Leeds LS1 4AB", "address"), ("P.O. Box 4410, Harlow", "address"), ("deliver to Hauptstraße 12, 10115 Berlin", "address"),
    ("he lives at 33 rue Victor Hugo, 69002 Lyon", "address"), ("Calle Mayor 15, 28013 Madrid is the office", "address"), ("send the parcel to 9 Orchard Close, Bath", "address"), ("visit us at Kastanienallee 82, 10435 Berlin", "address"), ("the letter for Flat 3, 21 Mill Lane, York", "address"),
    ("git clone git@git.internal.example:team/app.git", None), ("ssh root@10.0.0.5 uptime", None), ("scp build.tgz deploy@web1.example:/srv", None), ("npm install left-pad@1.3.0", None), ("the build took 1048576 ms on node 3", None), ("Error 404-2024-11 in module seven", None),
    ("released version 2024.11.28 of the schema", None), ("commit 9f8e7d6c5b4a was reverted", None), ("order 2231-5541-90 is a sample", None), ("listen on 127.0.0.1:8080", None), ("The Ruby library and the Swift package are slow", None), ("Use Visual Studio Code to open the file", None),
    ("row 48213377 was dropped at 2025-03-04 10:22", None), ("every drive in the way of the road test failed", None), ("took 3600 seconds in 12 runs", None), ("The Parser reads each line once.", None), ("port 5432, timeout 30000, retries 5", None), ("uuid 5b1e9c70-44aa-4c1e-9d33-0a1b2c3d4e5f is stale", None),
    ("set LIMIT=4096 and THREADS=16", None), ("Kubernetes needs a new node pool", None), ("see chapter 12, section 4 and page 1180", None), ("the Julia script and the Crystal build are green", None), ("checksum 0123456789 does not match", None), ("Monday was quiet", None), ("Each request is logged before March", None), ("import { thing } from '@scope/pkg'", None),
]


def test_held_out_precision_and_recall(spark, sf_dir):
    calls = spark.read.parquet(f"{sf_dir}/../sf0.01/call_contexts.parquet")
    fitted = privacy.fit_on(calls.select("command").union(calls.select("transcript_tail")).toDF("t").where("t <> ''"), "t")
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HELD_OUT)], "id int, t string")
    got = {r.id: set(r.kinds) for r in privacy.redact_with(df, "t", *fitted).collect()}
    wrong = [(HELD_OUT[i], kinds) for i, kinds in got.items() if kinds != ({HELD_OUT[i][1]} - {None})]
    for kind in privacy.KINDS:
        true, found = {i for i, (_, k) in enumerate(HELD_OUT) if k == kind}, {i for i, kinds in got.items() if kind in kinds}
        print(kind, "precision", round(len(true & found) / max(1, len(found)), 3), "recall", round(len(true & found) / len(true), 3))
        assert len(true & found) >= 0.9 * len(true) and len(true & found) >= 0.9 * len(found), (kind, wrong)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "mail a.b@c.example " * 2000, 5), (3, "mail a.b@c.example " * 2000, 5), (4, "plain words", 5)], "id int, t string, kinds int").withColumn("_spans", F.lit(1))
    got = sorted(privacy.redact_texts(df, "t").select("id", "redacted", "kinds").collect(), key=lambda r: r.id)
    assert [r.redacted for r in got[:2]] == [None, ""] and all(r.kinds == [] for r in got[:2]) and got[4].redacted == "plain words"
    assert all(r.kinds == ["email"] and r.redacted == "mail [EMAIL] " * 2000 for r in got[2:4])
    assert privacy.redact_texts(df.where("false"), "t").count() == 0


@pytest.mark.parametrize("text", ["why does bartek_35@post.invalid get two copies", "ｍail to ｂart.k＠post.invalid — now"])
def test_placeholders_keep_the_rest(spark, text):
    rows = spark.createDataFrame([(text,)], "t string")
    r = privacy.redact_texts(rows, "t").head()
    assert r.kinds == ["email"] and r.redacted.replace("[EMAIL]", "") in (text.replace("bartek_35@post.invalid", ""), text.replace("ｂart.k＠post.invalid", ""))
