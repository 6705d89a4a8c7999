from granary.llm import quality


def test_letters_mean_the_same_at_every_length():
    for text in ("—“\U0001f600。́", "aé漢́ 1\U0001f600", "x" * 7):
        short, long = quality.features(text * 100), quality.features(text * 1000)
        assert short[4] == long[4] == sum(map(str.isalpha, text)) / len(text)
