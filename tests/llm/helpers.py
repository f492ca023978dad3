import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(TO_LOWER))


def nonspace_words(text):
    return NONSPACE.findall(text or "")


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(spark, texts, lang="en", source="s"):
    made = [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, DOCS)


ODD_TEXTS = [None, "", " ", "\n\n", "one", "é", "日本語 テキスト", "a\x00b 　 c", "x" * 200_000, "word " * 60_000, "A b C d E f G h I j K l M n O", "A b C d E f G h I j K l M n O", "🙂 emoji 'tis don't WE'LL", "tab\tand\vmore\r\nlines\r\n"]
