import gzip

from pyspark.sql import functions as F

from larder.functions import classify
from larder.plans import medallion
from larder.sources import files, keyed, rest
from larder.streaming import bronze


def test_dump(spark, tmp_path):
    path = tmp_path / "dump.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write('code\tproduct_name\tproteins_100g\n1\tA "quoted" name\t5.5\n2\tB\t\nbad\n')
    got = files.read_tsv(spark, str(path), ["code", "product_name", "absent"], drop_bad=True, parts=2)
    assert sorted(map(tuple, got.collect())) == [("1", 'A "quoted" name'), ("2", "B")]


def test_sheets_and_merge(spark, tmp_path):
    (tmp_path / "one.csv").write_text("x,y,fat\n1,Milk,3\n")
    (tmp_path / "two.csv").write_text("x,y,iron\n1,Milk,2\n2,Tea,1\n")
    from larder.operators.matching import outer_merge

    sheets = files.read_sheets(spark, str(tmp_path), ["one", "none", "two"])
    got = outer_merge(sheets, ["food_code", "description"])
    assert sorted(map(tuple, got.select("food_code", "description", "fat", "iron").collect())) == [("1", "Milk", "3", "2"), ("2", "Tea", None, "1")]


def test_upsert(spark, tmp_path):
    table = str(tmp_path / "t")
    files.upsert_parquet(spark, table, spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), "id")
    last = files.upsert_parquet(spark, table, spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "id long, x string, y int"), "id")
    assert files.current_version(spark, table).split("/")[-1] == last.split("/")[-1]
    assert sorted(map(tuple, spark.read.parquet(last).collect())) == [(1, "a", None), (2, "c", 1), (3, "d", 2)]


def test_first_load_settles_ties(spark, tmp_path):
    rows = [(1, "b"), (1, "c"), (1, "a"), (2, "x"), (2, "x")]
    first = files.upsert_parquet(spark, str(tmp_path / "t"), spark.createDataFrame(rows, "id long, x string"), "id")
    assert sorted(map(tuple, spark.read.parquet(first).collect())) == [(1, "c"), (2, "x")]


def test_append_quotes_names_and_ends_lines(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    rows = lambda *x: spark.createDataFrame([*x], ["Thiamin, B1 (mg)", "y"])
    files.append_csv(rows(("1", "2")), path)
    (tmp_path / ".one.csv.crc").unlink()  # edited by another program
    with open(path, "rb+") as f:
        f.truncate(len(f.read()) - 1)
    files.append_csv(rows(("3", "4")), path)
    got = spark.read.option("header", True).csv(path)
    assert got.columns == ["Thiamin, B1 (mg)", "y"] and sorted(map(tuple, got.collect())) == [("1", "2"), ("3", "4")]


def test_foods(spark):
    df = spark.createDataFrame([("u1", "Milk", "64", "3.2", None), (None, "Tea", "x", "nan", "1"), ("u3", " ", "1", "1", "1")], "source_id string, ref_name string, kcal string, protein string, iron string")
    got = files.read_foods(df, ["source_id"], "ref_name", {"calories": "kcal", "protein": "protein", "iron": "iron"}).collect()
    assert [tuple(r) for r in got] == [("u1", "Milk", 64.0, {"protein": 3.2, "iron": 0.0}), ("Tea", "Tea", 0.0, {"protein": 0.0, "iron": 1.0})]
    assert files.mock_foods(spark).count() == 6


def test_rest(spark):
    food = {"fdcId": 1, "description": "Milk", "foodNutrients": [{"nutrient": {"name": "Iron", "unitName": "MG"}, "amount": 2.0}, {"nutrientName": "Iron", "unitName": "MG", "value": 3.0}]}
    found = rest.pages(lambda _, p: {"foods": [food] if p["pageNumber"] < 3 else []}, "u", "milk", ["Foundation"])
    df = rest.to_table(spark, found, search_category="milk")
    assert df.count() == 2 and df.first().search_category == "milk"
    assert list(rest.details(lambda _, p: [len(p["fdcIds"])], "u", list(range(45)), pause=0)) == [20, 20, 5]
    from larder.operators.columns import flatten_nutrients

    flat = flatten_nutrients(df.limit(1), "fdcId", "foodNutrients")
    assert flat.columns == ["fdcId", "nut_iron_mg"] and flat.first().nut_iron_mg == 3.0


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tsv").write_text("code\tname\n1\tone\n2\ttwo\n")
    args = ("code", str(tmp_path / "table"), str(tmp_path / "check"))
    bronze.upsert_stream(bronze.product_stream(spark, str(folder), "code string, name string"), *args).awaitTermination()
    (folder / "b.tsv").write_text("code\tname\n2\tTWO\n3\tthree\n")
    bronze.upsert_stream(bronze.product_stream(spark, str(folder), "code string, name string"), *args).awaitTermination()
    got = keyed.read(spark, str(tmp_path / "table"))
    assert sorted(map(tuple, got.collect())) == [("1", "one"), ("2", "TWO"), ("3", "three")]


def test_arrivals(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:15:00", "b")], "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "e"))
    run = bronze.arrivals(stream, "ts", "kind").writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("arrivals").collect()) == [("a", 2), ("b", 1)]


NUTRIENTS = ["Energy (KCAL)", "Protein (g)", "Carbohydrate (g)", "Fat (g)", "Iron (mg)"]


def test_silver_and_reference_gold(spark):
    raw = spark.createDataFrame([("1", "Beef, raw", 200.0, 20.0, 10.0, 0.0, 2.0), ("2", "Beef, roasted", 210.0, 30.0, 10.0, 0.0, 3.0), ("3", "Odd", 100.0, 90.0, 90.0, 0.0, None), ("4", "Milk", 950.0, 3.0, 3.0, 4.0, None)], "food_code string, food string, kcal double, protein double, fat double, carbs double, iron_MG_100G double")
    source = medallion.Source("cofid", {"food": "description", "kcal": "Energy (KCAL)", "protein": "Protein (g)", "fat": "Fat (g)", "carbs": "Carbohydrate (g)"}, classify.keyword_descriptor("food"), ["food_code", "description"], NUTRIENTS)
    clean, flagged = medallion.silver(raw, source)
    assert clean.columns == ["food_code", "description", "semantic_descriptor", *sorted(NUTRIENTS), "data_source"]
    assert [r.food_code for r in flagged.collect()] == ["3"] and flagged.first().flag_reason.startswith("MACRO_SUM")
    got = {r.food_code: r for r in clean.collect()}
    assert got["4"]["Energy (KCAL)"] is None and got["1"]["Iron (mg)"] == 2.0 and got["1"].semantic_descriptor.startswith("animal")
    rows = clean.withColumn("food_code", F.col("food_code").cast("long"))
    labels = spark.createDataFrame([(1, "single", 0), (2, "category", 0), (2, "single", 1)], "source_id long, food_type_label string, ord int")
    gold, log = medallion.reference_gold([rows, rows], labels, "food_code", "description", ["Energy (KCAL)"], ["Iron (mg)"])
    base = {r.base_name: r for r in gold.collect()}
    assert set(base) == {"Beef, raw", "Milk"} and base["Beef, raw"].n == 1 and base["Beef, raw"]["Energy (KCAL)"] == 200.0
    assert [(r.merged_name, r.base_target) for r in log.collect()] == [("Beef, roasted", "Beef, raw")]


def test_products(spark):
    rows = [(1, "Tesco Cheddar 350g", "cheddar cheese", "Tesco", 400.0, 25.0, 0.1, 34.0, 0.001, "United Kingdom"), (2, "Tesco Cheddar 500g", "cheddar cheese", "Tesco", 402.0, 25.0, 0.1, 34.0, 0.001, "united kingdom, France"), (3, "Tesco Cheddar", "cheddar cheese", "Asda", 300.0, 25.0, 0.1, 22.0, None, "United Kingdom"), (4, "Pizza", None, None, 250.0, 10.0, 30.0, 9.0, None, "United Kingdom"), (5, "Foreign", None, None, 1.0, 1.0, 1.0, 1.0, None, "France")]
    df = spark.createDataFrame(rows, "id long, product_name string, category string, brands string, `Energy (KCAL)` double, `Protein (g)` double, `Carbohydrate (g)` double, `Fat (g)` double, `Iron (mg)` double, countries string")
    silver = medallion.products_silver(df, "id", "product_name", "category", NUTRIENTS, ("countries", "united kingdom"), ["brands"])
    got = sorted((r.norm_name, r.main_category_en, r.n, r.size_variation, r["Iron (mg)"]) for r in silver.collect() if r.main_category_en)
    assert got == [("tesco cheddar", "cheddar cheese", 1, "", None), ("tesco cheddar", "cheddar cheese", 2, "350g | 500g", 1.0)]
    gold = medallion.products_gold(df, "id", "product_name", "category", "brands", NUTRIENTS)
    labels = sorted((r.food_type_label, r.product_count) for r in gold.collect())
    assert ("composite", 1) in labels and sum(n for _, n in labels) == 5


def test_platinum(spark):
    products = spark.createDataFrame([(1, [1.0, 0.0], 100.0), (2, [0.0, 1.0], 100.0)], "id long, vector array<double>, kcal double")
    refs = spark.createDataFrame([(10, "Milk, raw", [1.0, 0.05], 101.0, 2.0, True, False), (11, "Milk, boiled", [1.0, 0.0], 103.0, 1.0, False, True)], "id long, name string, vector array<double>, kcal double, iron double, is_raw boolean, is_cooked boolean")
    enriched, unmatched = medallion.platinum(products, refs, ["kcal"], ["iron"])
    assert [(r.id, r.ref_name, r.iron, r.confidence) for r in enriched.collect()] == [(1, "Milk, raw", 2.0, "HIGH")]
    assert [r.id for r in unmatched.collect()] == [2]


def test_encoding_fallback(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "food.csv").write_bytes("name,kcal\nCrème,5\n".encode())
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "food.csv").write_bytes("name,kcal\nPâté,7\n".encode("latin1"))
    (tmp_path / "b" / "other.csv").write_bytes(b"x\n1\n")
    got = files.read_csv(spark, str(tmp_path), recursive=True, pattern="food.csv", fallback="ISO-8859-1")
    assert sorted(map(tuple, got.collect())) == [("Crème", 5), ("Pâté", 7)]
    assert files.read_csv(spark, str(tmp_path / "a"), fallback="ISO-8859-1").first().name == "Crème"
    only = files.read_csv(spark, str(tmp_path / "b"), pattern="food.csv", schema="name string, kcal int", fallback="ISO-8859-1")
    assert [tuple(r) for r in only.collect()] == [("Pâté", 7)]


def test_workbook(spark, tmp_path):
    import zipfile

    main, rel = files._SHEET["m"], files._SHEET["r"]
    row = lambda n, *cells: f'<row r="{n}">{"".join(cells)}</row>'
    sheet = row(1, '<c r="A1" t="inlineStr"><is><t>Title</t></is></c>') + row(3, '<c r="C3" t="s"><v>0</v></c>', '<c r="E3" t="s"><v>1</v></c>') + row(4, '<c r="A4" t="str"><v>11-001</v></c>', '<c r="B4" t="s"><v>2</v></c>', '<c r="C4"><v>3.5</v></c>', '<c r="E4"><v>2</v></c>') + row(6, '<c r="A6" t="str"><v>11-002</v></c>')
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Proximates" sheetId="1" r:id="rId1"/><sheet name="Notes" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Protein (g)</t></si><si><r><t>Fat</t></r><r><t> (g)</t></r></si><si><t>Milk &amp; tea</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
    got = files.read_workbook(spark, str(tmp_path / "book.xlsx"), ["Absent", "Proximates", "Notes"])
    assert list(got) == ["Proximates", "Notes"] and got["Notes"].count() == 0
    assert got["Proximates"].columns == ["food_code", "description", "Protein (g)", "Fat (g)"]
    assert [tuple(r) for r in got["Proximates"].collect()] == [("11-001", "Milk & tea", "3.5", "2"), ("11-002", None, None, None)]


def test_sinks(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "a,b"), (2, 'c"d')], "x int, y string")
    path = str(tmp_path / "one.csv")
    files.append_csv(df, path)
    files.append_csv(df.where("x = 2"), path)
    text = (tmp_path / "one.csv").read_text().splitlines()
    assert text[0] == "x,y" and len(text) == 4 and sum(line == "x,y" for line in text) == 1
    assert sorted(map(tuple, spark.read.csv(path, header=True, escape="\\").collect())) == [("1", "a,b"), ("2", 'c"d'), ("2", 'c"d')]
    with pytest.raises(ValueError):
        files.append_csv(df.select("x"), path)
    files.write_csv(df, str(tmp_path / "many"))
    assert files.read_csv(spark, str(tmp_path / "many")).count() == 2
    files.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    (tmp_path / "doc.json").write_text('{"a": [1, 2]}')
    assert files.read_json_table(spark, str(tmp_path / "doc.json")) == {"a": [1, 2]}
    assert "<td>a,b</td>" in files.html_report(df)


def test_downloads(tmp_path):
    import io
    import tarfile
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("in/food.csv", "x\n1\n")
    calls = []
    get = lambda url: calls.append(url) or iter([held.getvalue()[:10], held.getvalue()[10:]])
    for _ in range(2):
        path = files.fetch_file(get, "https://example.org/data/foods.zip?x=1", str(tmp_path / "cache"))
    assert path.endswith("foods.zip") and len(calls) == 1
    assert (tmp_path / "cache" / "foods.zip").read_bytes() == held.getvalue()
    for _ in range(2):
        files.unpack(path, str(tmp_path / "foods"))
    assert (tmp_path / "foods" / "in" / "food.csv").read_text() == "x\n1\n"
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        t.add(tmp_path / "foods" / "in" / "food.csv", "food.csv")
    assert (tmp_path / "tar" / "food.csv").exists() or files.unpack(str(tmp_path / "t.tgz"), str(tmp_path / "tar")) and (tmp_path / "tar" / "food.csv").exists()


def test_crawl(spark, tmp_path):
    calls = []

    def fetch(_, payload):
        calls.append(payload["query"])
        n = payload["pageNumber"]
        return {"foods": [{"fdcId": n, "description": payload["query"]}] if n < 3 else []}

    for _ in range(2):
        got = rest.crawl(spark, fetch, "u", ["milk", "soy sauce"], ["Foundation"], str(tmp_path / "foods"))
    assert sorted((r.fdcId, r.description, r.search_category) for r in got.collect()) == [(1, "milk", "milk"), (1, "soy sauce", "soy sauce"), (2, "milk", "milk"), (2, "soy sauce", "soy sauce")]
    assert len(calls) == 6


def test_macros():
    from larder.operators.columns import macro_columns

    assert macro_columns(["Energy (KCAL)", "Iron (mg)", "Total Fat (g)", "Vitamin C (mg)", "DHA (g)"]) == (["Energy (KCAL)", "Total Fat (g)", "DHA (g)"], ["Iron (mg)", "Vitamin C (mg)"])


def test_app_runs(spark, tmp_path):
    head = "code\tproduct_name\tbrands\tcategories_en\tcompleteness\tcountries_en\tenergy-kcal_100g\tproteins_100g\tfat_100g\tsodium_100g\tiron_100g\tfiber_100g\n"
    rows = ["1\tWhole Milk\tDairy\tMilks,Drinks\t0.8\tUnited Kingdom\t64\t3.3\t3.6\t0.04\t0.1\t0", "2\tTea\t\tTeas\t0.9\tFrance\t1\t0\t0\t0\t0\t0", "3\tVague\t\tX\t0.4\tUnited Kingdom\t1\t1\t1\t0\t0\t0", "4\tOdd\t\tX\t0.9\tunited kingdom\t-1\t1\t1\t0\t0\t0", "5\tFew\t\tX\t0.9\tUnited Kingdom\t5\t1\t1\t\t\t", "6\tSemi Milk\t\tMilks\t0.7\tFrance, United Kingdom\t65\t3.4\t3.5\t0.05\t0\t0", "bad"]
    dump = tmp_path / "dump.tsv.gz"
    with gzip.open(dump, "wt") as f:
        f.write(head + "\n".join(rows) + "\n")
    names = {"energy-kcal_100g": "Energy", "proteins_100g": "Protein", "fat_100g": "Fat", "sodium_100g": "Sodium (mg)", "iron_100g": "Iron", "fiber_100g": "Fiber"}
    got = medallion.ingest_app_foods(spark, str(dump), str(tmp_path / "out"), names, ["energy-kcal_100g", "proteins_100g", "fat_100g"], ("countries_en", "united kingdom"))
    assert sorted((r.food_id, r.description, r.food_group, r["Sodium (mg)"]) for r in got.collect()) == [("off_1", "Whole Milk - Dairy", "Milks", 40.0), ("off_6", "Semi Milk", "Milks", 50.0)]
    foods = spark.createDataFrame([(10, "Milk, whole", 64.0, 3.3), (11, "Milk, semi", 40.0, 3.4), (12, "Tea", 1.0, 0.0)], "id long, name string, kcal double, protein double")
    best = medallion.match_store_products(spark, str(dump), foods, str(tmp_path / "map"), {"energy-kcal_100g": "kcal", "proteins_100g": "protein"}, ("countries_en", "united kingdom"), least=50)
    assert [(r.product_id, r.food_id, r.food_name) for r in best.orderBy("product_id").collect()] == [("1", 10, "Milk, whole"), ("6", 10, "Milk, whole")]
