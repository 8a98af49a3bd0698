import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from khata.llm import garble

BANGLA = "নদীর ধারে মানুষ জড়ো হয়েছে"
HINDI = "लोग नदी के किनारे"


def wrong(text, name):
    """Text as it comes out when its bytes are read under another encoding; bytes that it lacks become control characters."""
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("name", ["cp1252", "latin-1", "iso8859-15", "cp1251", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("text", [BANGLA, HINDI, "naïve café", "it’s"])
def test_round_trip(name, text):
    bad = f"Before {wrong(text, name)} after."
    assert garble.restored(bad)[0] == f"Before {text} after."


def test_layers():
    bad = wrong(wrong(BANGLA, "cp1252"), "cp1252")
    assert garble.restored(bad)[:2] == (BANGLA, 2)


def test_more_rounds_than_six():
    bad = BANGLA
    for _ in range(8):
        bad = wrong(bad, "cp1252")
    assert garble.restored(bad)[:2] == (BANGLA, 8)
    assert garble.restored("Ã’a")[:2] == ("Òa", 1)


def test_double_byte():
    assert garble.restored("soir茅e")[0] == "soirée"
    bad = BANGLA.encode().decode("gb18030", "replace")
    assert garble.is_garbled(bad)
    assert sum("\u0980" <= c <= "\u09ff" for c in garble.restored(bad)[0]) > len(BANGLA) / 2


@pytest.mark.parametrize("name", ["gb18030", "cp932"])
@pytest.mark.parametrize("text", ["don’t", "We’ve seen it—and “they” said so.", "“Yes” he’d", "wait…then", "crème brûlée", "créée", "a €5b note", "3 m²x", "So \U0001f600!"])
def test_latin_text_under_a_double_byte_encoding(name, text):
    bad = text.encode().decode(name, "replace")
    got = garble.restored(bad)[0]
    assert garble.is_garbled(bad) and ("�" in bad or got == text)


@pytest.mark.parametrize(("bad", "text"), [("don鈥檛", "don’t"), ("don窶冲", "don’t"), ("naﾃｯve", "naïve"), ("soir챕e", "soirée"), ("soir矇e", "soirée"), ("soir辿e", "soirée"), ("鈥淵es鈥� he", "“Yes鈥� he"), ("it鈥檚 拢 x", "it’s £ x"), ("鈥榓鈥� x", "‘a鈥� x")])
def test_marks_and_letters_of_double_byte_encodings(bad, text):
    assert garble.restored(bad)[0] == text and garble.is_garbled(bad)


@pytest.mark.parametrize("text", ["(路)", "陆路", "the word 猫 here", "中山路5号", "日本語のテキスト", "한국어 문장", "ｱｲｳ", "窗口", "東京タワー Tokyo"])
def test_eastern_words_stay(text):
    assert garble.restored(text) == (text, 0, [])


def test_stretch_inside_good_text():
    text = f"{BANGLA} “{wrong(BANGLA, 'cp1252')}” {HINDI}"
    assert garble.restored(text)[0] == f"{BANGLA} “{BANGLA}” {HINDI}"


def test_lost_bytes_are_found_and_the_rest_restored():
    bad = wrong("বনের", "cp1252").replace("°", "?")
    assert garble.is_garbled(bad) and garble.restored(bad)[0].startswith("বনে")
    assert garble.is_garbled("an �tude")


@pytest.mark.parametrize("text", ["", "plain", BANGLA, HINDI, "café Übermut São Ångström", "€40 – m² → »", "слово Москва", "(水)", "Thе οld brіdge", "Ｔｈｅ", "\U0001f60d\U0001f525", "‘a’ “b”…"])
def test_good_text_stays(text):
    assert garble.restored(text) == (text, 0, [])


@given(st.text(alphabet="abc কারন।é—", max_size=40))
def test_ordinary_alphabets_are_never_garbled(text):
    assert not garble.is_garbled(text)


def test_table(documents, rows):
    df = documents([None, "", BANGLA, wrong(BANGLA, "cp1252"), wrong(BANGLA, "cp1252"), "x�", wrong(BANGLA, "cp1251") * 300])
    got = {r["doc_id"]: (r["text"], r["whole"]) for r in garble.garbled(df).collect()}
    assert got == {4: (BANGLA, True), 5: (BANGLA, True), 6: ("x�", False), 7: (BANGLA * 300, True)}
    assert garble.garbled(df.limit(0)).count() == 0


#: Ordinary words by language; sentences are made of them by rule.
WORDS = {
    "ru": "правительство россии приняло новый закон о защите окружающей среды её моё своё ещё всё ред рек рог род рим режь рожь реку роду дом вода город люди время жизнь день рука раз дело глаз там тем сам тип чем это был объём подъезд съел щёки ёлка Его Она Редкий Рекорд",
    "uk": "уряд україни ухвалив новий закон про захист довкілля її мої свої ґанок їжа він вона місто люди час життя день рука річ діло око там цей був об’єкт під’їзд з’їв щоки ялинка київ європа ще їхній Віра Єва Її",
    "el": "η κυβέρνηση ανακοίνωσε νέα μέτρα για την προστασία του περιβάλλοντος και των πολιτών Έλληνες Όλοι Άννα σήμερα αύριο χθες νερό πόλη άνθρωποι χρόνος ζωή ημέρα χέρι μία δουλειά μάτι εκεί αυτός ήταν προϊόν γαϊδούρι ΰ",
    "th": "รัฐบาล ประกาศ นโยบาย ใหม่ เกี่ยวกับ การ ศึกษา ของ ประเทศ ไทย น้ำ เมือง คน เวลา ชีวิต วัน มือ ครั้ง งาน ตา ที่นั่น นี้ เป็น เกม เขต เพศ เธอ เดิน เพลง โดย เกษตร ไฟ ใจ แม่ เรา",
    "zh": "政府 宣布 新 的 环境 保护 法律 和 公民 今天 明天 水 城市 人们 时间 生活 路 猫 么 美 迷 茅台 卤 驴 芦 禄 吡啶 硼 开始 问题 手机 中山路 陆路 窗口",
    "ja": "政府は 新しい 環境保護法を 発表した 今日 明日 水 都市 人々 時間 生活 東京 タワー コンピュータ ﾃｽﾄ ﾃｷｽﾄ ｱｲｳ 日本語の テキスト 猫 道 縺れ 繧繝 山 川",
    "ko": "정부는 새로운 환경 보호 법을 발표했다 오늘 내일 물 도시 사람들 시간 생활 책 처 철 차 짧은 한국어 문장 서울 집 길 나무 창 참",
    "ar": "أعلنت الحكومة قانونا جديدا لحماية البيئة اليوم غدا ماء مدينة ناس وقت حياة آپ آگ آج گاؤں چائے پاکستان ژاله کتاب آب إلى أن لا ة",
    "cs": "vláda přijala nový zákon o ochraně životního prostředí dnes zítra voda město lidé čas život den ruka oko tam tento byl příliš žluťoučký kůň úpěl ďábelské ódy Číž Šašek Žďár ŽIŽKOV ĎÁBEL",
    "tr": "hükümet çevrenin korunmasına ilişkin yeni yasayı kabul etti bugün yarın su şehir insanlar zaman yaşam gün el göz orada bu İstanbul’da ABDİ’nin NEŞ’E TÜRKİYE’nin Ağrı ığdır",
    "vi": "chính phủ thông qua luật mới về bảo vệ môi trường hôm nay ngày mai nước thành phố người thời gian cuộc sống ngày tay mắt ở đó này là ĐÂY LÀ ÂU CƠ TÂY NGUYÊN Đà Nẵng",
    "fr": "le gouvernement a adopté une loi à la forêt où ça été là « voilà » l’été à l’œuvre naïve Noël ÂGE ÇA À PARÂTRE dîner",
    "fi": "hallitus hyväksyi uuden lain ympäristön suojelusta tänään huomenna vesi kaupunki ihmiset ”HYVÄ” ”PÄIVÄÄ” IKEÄ’s ÄÄNI Ö",
    "pt": "o governo aprovou uma lei de proteção ambiental amanhã NÃO “AMANHÔ MANHÃ’ MAÇÃ É À AÇÃO coração 1ª nº 5º",
}


@pytest.mark.parametrize("lang", WORDS)
def test_two_hundred_sentences_of_other_languages_stay(lang):
    words = WORDS[lang].split()
    between = "" if lang in ("zh", "ja", "th") else " "
    for k in range(200):
        many = [words[(k * 7 + i * (1 + k % 13) + i * i) % len(words)] for i in range(3 + k % 9)]
        text = [between.join(many) + ".", " ".join(many), f"“{between.join(many)}” – {many[0]}", f"In English: {many[1]} ({many[0]}) 5{many[2]}"][k % 4]
        assert garble.restored(text) == (text, 0, []), text


def test_signs_that_the_encoding_lacks_stay():
    bad = BANGLA.encode().decode("cp932", "replace") + " \U0001f600 Ω"
    new, _, _ = garble.restored(bad)
    assert new.endswith(" \U0001f600 Ω")
    assert not garble._all_rounds(bad)[2]
    assert garble._all_rounds("বনে".encode().decode("gb18030", "replace") + "\U0001f600")[0].endswith("\U0001f600")


def test_many_encodings_in_one_text():
    names = ["cp1252", "cp437", "mac_roman", "cp850", "iso8859-15", "cp1251", "koi8-r", "cp866"]
    bad = "\n".join(wrong(BANGLA, n) for n in names)
    assert garble._all_rounds(bad)[0] == "\n".join([BANGLA] * len(names)) and garble._all_rounds(bad)[2]


def test_lost_signs_make_it_not_whole():
    new, used, whole = garble._all_rounds("বাংলার গ্রাম".encode().decode("cp1252", "ignore"))
    assert used and not whole and new.startswith("বাংলার")


def test_words_of_other_scripts_are_restored():
    assert garble.restored(wrong("a bridge (мост).", "cp1252"))[0] == "a bridge (мост)."


@pytest.mark.parametrize("text", ["中文没有空格" * 60_000, "её" * 200_000, "她 и я " * 60_000, wrong("নদী", "cp1252") * 60_000, "Ã" * 300_000, "Ã©" * 100_000, "鈥" * 200_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.perf_counter()
    garble.restored(text)
    assert time.perf_counter() - began < 20
