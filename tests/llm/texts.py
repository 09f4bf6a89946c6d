"""Texts with the cases that every text operator must handle."""

EDGE = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "one", "b"), (5, "one two", None), (6, "one two three", "a"),
    (7, "the cat sat on the mat " * 9, "a"), (8, "the cat sat on the mat " * 9, "a"), (8, "the cat sat on the mat " * 9, "a"),
    (9, "É A\x0bb\x0cc d e \U0001f600 # $ 12\r\nline\nline\n\nline", "c"), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "c"),
    (None, "no id but words enough to be kept by the base rule of ten", "c"), (11, "x y z w v " * 4000 + "end", "hot"), (12, "aaaa " * 3 + "b c d e f aaaa aaaa aaaa b", "hot"),
]
SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows=EDGE, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
