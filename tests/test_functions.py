import datetime
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from signet.functions import labels as L
from signet.functions import text as T


def many(spark, make, rows):
    """``make`` of each tuple of texts, in one job."""
    width = len(rows[0])
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["i int", *(f"c{k} string" for k in range(width))]))
    return [r[0] for r in frame.select(make(*(F.col(f"c{k}") for k in range(width))).alias("x"), "i").orderBy("i").collect()]


def test_case_of_turkish_letters(spark):
    rows = [("İNCİ IRMAK",), ("DIŞ İŞLER",), ("İZMİR",), ("Çığ",), ("ŞI",), (None,), ("",)]
    assert many(spark, T.tr_lower, rows) == ["inci ırmak", "dış işler", "izmir", "çığ", "şı", None, ""]
    assert many(spark, T.tr_upper, [("inci ırmak",), ("üzüm",), ("ığdır",)]) == ["İNCİ IRMAK", "ÜZÜM", "IĞDIR"]


def plain(text):
    """The definition, letter by letter."""
    text = unicodedata.normalize("NFC", text).replace("İ", "i").replace("I", "ı").lower().replace("ı", "i")
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in folded.lower()).split())


def test_normalised_text_is_that_of_the_definition(spark):
    rng = random.Random(3)
    letters = "abcçdeğıiİIjoöşŞuüÜâîû 09.-'ñéÀß½ﬁ日Ａ" + "̧̇"
    rows = [("".join(rng.choice(letters[:-2]) for _ in range(rng.randrange(1, 30))),) for _ in range(300)]
    rows += [(unicodedata.normalize("NFD", r[0]),) for r in rows[:100]] + [("ofis ½ ﬁrma",), ("İpek",)]
    assert many(spark, T.tr_normalize, rows) == [plain(r[0]) for r in rows]


def test_names(spark):
    pairs = {("Gül ŞEN", "gul sen"): True, ("  Ömer  ÇAĞ. ", "OMER CAG"): True, ("Ilgaz Kır", "ILGAZ KIR"): True, ("Nur Ak", "Nur Aka"): False, ("", ""): False, ("--", "??"): False, (None, "a"): False}
    assert many(spark, T.name_equal, list(pairs)) == list(pairs.values())
    assert many(spark, T.normalize_name, [(" Şule  IŞIN-Öz ",), ("Kâzım",), ("\u0130nan",), ("Ａli ﬁl",)]) == ["şule ışın öz", "k zım", "inan", "ali fil"]


def core(name):
    """Trailing legal forms go, the longest first, while something is left."""
    forms = [f.split() for f in sorted([*T.LEGAL_PAIRS, *T.LEGAL_WORDS], key=lambda f: -len(f.split()))]
    words = plain(name).split()
    while (fit := next((f for f in forms if words[-len(f) :] == f), None)) is not None and len(fit) < len(words):
        words = words[: -len(fit)]
    return " ".join(words).replace("san ve tic", "sanayi ve ticaret").replace("san tic", "sanayi ticaret")


def test_company_cores_of_all_short_names(spark):
    words = ["Nil", "Limited", "ŞİRKETİ", "Şti.", "Ltd", "A.Ş.", "Kollektif", "anonim", "Komandit", "as", "san", "tic", "ve"]
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))),) for _ in range(600)]
    rows = [r for r in rows if not plain(r[0]).startswith(("san tic san", "san ve tic san"))]
    got = dict(zip(rows, many(spark, T.company_core, rows), strict=True))
    wrong = {r[0]: (x, core(r[0])) for r, x in got.items() if x != core(r[0]) and "san" not in plain(r[0]).split()}
    assert not wrong
    assert many(spark, T.company_equal, [("Nil Gıda San. ve Tic. Kollektif Şirketi", "NİL GIDA SANAYİ VE TİCARET"), ("Nil Gıda A.Ş.", "Nil Tarım A.Ş."), ("", "")]) == [True, False, False]


def test_identifiers(spark):
    assert many(spark, T.digits_only, [("No 4-56 / 7",), ("yok",), (None,)]) == ["4567", "", None]
    assert many(spark, T.masked_id, [(" 456***89 ",), ("456********89",), ("45678901289",), ("45***89",)]) == ["456******89", "456******89", None, None]
    assert many(spark, T.masked_equal, [("456*89", "456****89"), ("456*89", "456*88"), (None, None)]) == [True, False, False]
    valid = []
    for base in (234567890, 518203947, 999999999):
        d = [int(c) for c in str(base)]
        tenth = (7 * sum(d[0::2]) - sum(d[1::2])) % 10
        valid.append(f"{base}{tenth}{(sum(d) + tenth) % 10}")
    assert many(spark, T.valid_tckn, [(v,) for v in valid]) == [True] * 3
    assert many(spark, T.valid_tckn, [(v[:-1] + str((int(v[-1]) + 1) % 10),) for v in valid] + [("0" + valid[0][1:],), ("12",)]) == [False] * 5
    def vkn(nine):
        total = 0
        for i, c in enumerate(nine):
            moved = (int(c) + 9 - i) % 10
            part = moved * 2 ** (9 - i) % 9
            total += 9 if moved and not part else part
        return f"{nine}{(10 - total % 10) % 10}"
    numbers = [vkn(n) for n in ("408512763", "000000000", "999999999")]
    assert many(spark, T.valid_vkn, [(n,) for n in numbers] + [(numbers[0][:-1] + str((int(numbers[0][-1]) + 3) % 10),), ("1",)]) == [True] * 3 + [False] * 2


def test_dates(spark):
    day = datetime.date(2031, 11, 5)
    forms = ["05.11.2031", "5/11/2031", "5-11-2031", "5 Kasım 2031", " 05 KASIM 2031 ", "2031-11-05", "2031-11-5"]
    assert many(spark, T.parse_date, [(f,) for f in forms]) == [day] * len(forms)
    months = "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık".split()
    assert [d.month for d in many(spark, T.parse_date, [(f"7 {m} 2030",) for m in months])] == list(range(1, 13))
    refused = ["5.11.31", "30.02.2031", "11/15/2031", "5 Kasm 2031", "5 Kasım", "2031", "", " ", "sayı 12345", None, "2031-13-01"]
    assert many(spark, T.parse_date, [(f,) for f in refused]) == [None] * len(refused)
    quote = "1.2.2030 - 31.04.2030 ve 09/10/2030, 5-6-2030; 12.12.30"
    assert many(spark, T.dates_in, [(quote,), (None,)]) == [[datetime.date(2030, 2, 1), datetime.date(2030, 10, 9), datetime.date(2030, 6, 5)], []]
    assert many(spark, T.says_indefinite, [("Aksi Karar Alınıncaya Kadar geçerli",), ("SÜRESİZ",), ("bir yıl",), (None,)]) == [True, True, False, False]


def test_group_codes(spark):
    rows = [("C Grubu Yetkilileri",), ("III. Derece",), ("üçüncü derece imza yetkilisi",), ("3. Derece",), ("VII. Derece",), ("Yetkili",), (None,), ("A B grubu",)]
    assert many(spark, T.group_code, rows) == ["c", "3", "3", "3", "vii", "", "", "a b"]


def test_pages_and_chunks(spark):
    rows = spark.createDataFrame([([4],), ([2, 3, 4],), ([1, 3, 7],)], "p array<int>")
    got = rows.select(T.page_list(F.col("p"), "+").alias("a"), T.page_span(F.col("p")).alias("b"), T.chunk_pages(F.concat(F.lit("x_p"), T.page_list(F.col("p"), "+"))).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [("4", "4", [4]), ("2-4", "2-4", [2, 3, 4]), ("1+3+7", "1-7", [1, 3, 7])]
    assert many(spark, T.chunk_pages, [("x",), ("x_p",), ("x_p9-2",), ("x_pz",), (None,), ("a_p1_p6",)]) == [[], [], [], [], [], [6]]


def test_amounts_and_labels(spark):
    assert many(spark, T.parse_amount, [("1.234.567,8",), ("12 TL",), ("₺ 5,05",), ("1,234",), ("-3",), ("90071992547409,92",), ("",)]) == [123456780, 1200, 505, None, None, None, None]
    assert many(spark, T.slug, [("  Live AI/2 ",), ("--",), ("",), ("a",)]) == ["live-ai-2", "unknown", "unknown", "a"]
    assert many(spark, T.without_fence, [("```json\n{}\n```",), (" {} ",), ("```\nx",)]) == ["{}", "{}", "```\nx"]
    codes = many(spark, T.authorization_code, [(str(i),) for i in range(500)])
    assert len(set(codes)) == 500 and all(c.startswith("YTK-") and len(c) == 12 and set(c[4:]) <= set(T.CODE_LETTERS) for c in codes)


def test_labels_of_known_unknown_and_missing_codes(spark):
    assert many(spark, L.action, [("AUTHORITY_CREATED",), ("authority_created",), ("",), (None,)]) == ["Yetki kaydı oluşturuldu", "Kayıt güncellendi", "Kayıt güncellendi", "Kayıt güncellendi"]
    assert many(spark, L.actor, [("branch_user:7",), ("branch_user",), ("systematic",), ("mobile_user:",), (" system",), (None,)]) == ["Şube görevlisi", "Yetkili kullanıcı", "Sistem", "Mobil kullanıcı", "Yetkili kullanıcı", "Yetkili kullanıcı"]
    assert many(spark, lambda c: L.shown(c, L.SCOPES), [("real_estate",), ("Taşıt",), ("",), (None,)]) == ["Gayrimenkul işlemleri", "Taşıt", "", None]
    assert many(spark, lambda c: L.shown(c, L.SUBJECTS), [("CREDIT",), ("credit",)]) == ["Kredi kullanımı", "credit"]
    assert [tuple(x) for x in many(spark, L.verdict_badge, [("READY",), ("REGISTRY_CONFLICT",), ("?",), (None,)])] == [("Onaya hazır", "✓", "Uygun"), ("Sicil kaydıyla çelişiyor", "×", "Engel"), ("?", None, None), (None, None, None)]
    assert set(L.ONBOARDING_COLOURS.values()) == set(L.STATUSES) == set(L.STATUS_SYMBOLS) and set(L.ONBOARDING_COLOURS) == set(L.ONBOARDING_VERDICTS)
