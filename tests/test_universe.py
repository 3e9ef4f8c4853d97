from quarterloom.operators import universe as U


def test_containment_within_words(spark):
    names = ["ACME HOLDINGS INC", "BEL TEL COM LTD", "AB", "CAT"]
    issuers = [("THE XACME HOLDINGS INCORPORATED", "1"), ("BEL TEL COMPANY", "2"), ("BEL TEL", "9"), ("FABLE", "3"), ("FABLE", "3"), ("CRAB", "4"), ("CONCATENATE", "5"), (None, "6"), ("", "7")]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    i = spark.createDataFrame(issuers, "issuer string, cusip string")
    got = {r["name"]: (r["cusip"], r["n"]) for r in U.match_names(n, i, "name", "issuer", "cusip").collect()}
    assert got == {"ACME HOLDINGS INC": ("1", 1), "BEL TEL COM LTD": ("2", 1), "AB": ("3", 2), "CAT": ("5", 1)}
