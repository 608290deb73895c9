import random
import zlib

from riskframe.llm import toxicity as t

LEXICON = {"moron": (3, 90.0), "scu*": (2, 80.0), "scum": (3, 85.0)}


def matched(clause):
    """Patterns of a clause by looking at places and distances, without any state."""
    near = lambda i, n, *kinds: any(0 < abs(i - j) <= n and s in kinds for j, s in enumerate(clause))
    before = lambda i, n, *kinds: any(clause[j] in kinds for j in range(max(0, i - n), i))
    context = lambda i: t.REPORTED if before(i, i, t.REPORT) else t.NEGATED if before(i, 3, t.NEGATION) else t.PLAIN
    insults, threats = [], []
    for i, s in enumerate(clause):
        c = context(i)
        if s >= t.INSULT:
            aimed = c == t.PLAIN and near(i, 3, t.TARGET, t.OBJECT)
            insults.append((s - t.INSULT + 1) * 4 + (t.AIMED if aimed else c))
        if s == t.VERB:
            intents = [j for j in range(max(0, i - 3), i) if clause[j] == t.INTENT]
            after = any(x in (t.TARGET, t.OBJECT) for x in clause[i + 1 : i + 3])
            between = any(clause[k] == t.OBJECT and t.INTENT in clause[max(0, k - 3) : k] for k in range(max(0, i - 3), i))
            ahead = any(t.OBJECT in clause[max(0, j - 2) : j] for j in intents)
            if (intents and after) or between or ahead:
                threats.append(max(c, t.AIMED))
    grave = lambda p: (p % 4 < 2, p // 4, p % 4 in (1, 2))
    return tuple(x for x in (max(insults, key=grave, default=0), min(threats, default=0)) if x)


def test_automaton_equals_brute_force_matching():
    rng = random.Random(3)
    automaton = t.Automaton(most=2_000)  # rebuilt now and then
    seen = set()
    for _ in range(30_000):
        clause = bytes(rng.choice([t.OTHER, t.OTHER, *range(t.TARGET, t.SYMBOLS)]) for _ in range(rng.randint(0, 12)))
        got = automaton.walk(clause)
        assert got == matched(clause), list(clause)
        seen.update(got)
    assert seen == {1, 2, 3, *range(4, t.PATTERNS)}


def test_clauses_not_words_are_scored():
    g = t.Grammar(LEXICON)
    of = lambda text: {p: n for p, n in g.clauses(text)[0].items()}
    strong = 4 * 4
    assert of("You moron. The sky is blue.") == {strong + 1: 1}
    assert of("moron moron") == {strong: 1}
    assert of("moron; moron") == {strong: 2}
    assert of("He is not a moron") == {strong + 2: 1}
    assert of("Not that it matters in any way today a moron") == {strong: 1}
    assert of("He said moron") == {strong + 3: 1}
    assert of("not a moron but you are scum") == {4 * 4 + 1: 1}
    assert of("A moron, far away from all of you") == {strong: 1}
    assert of("scummy") == {3 * 4: 1} and of("scum") == {4 * 4: 1}
    assert of("") == {} and of("nothing here") == {}


def test_threats_need_intent_verb_and_target_in_order():
    g = t.Grammar({})
    for text in ("I will kill you", "we're going to hurt them", "Ich werde dich töten", "je vais te tuer", "te voy a matar", "voy a matarte", "te mataré"):
        assert g.clauses(text)[0] == {1: 1}, text
    assert g.clauses("I will not kill you")[0] == {2: 1} and g.clauses("He said he will kill you")[0] == {3: 1}
    for text in ("kill the process", "you will beat the market", "will you kill the lights", "I will go. Kill you", "you kill", "I will kill time with a book for you"):
        assert g.clauses(text)[0] == {}, text


def test_each_transducer_has_an_effect_on_the_score():
    weights = [0.0] * t.FEATURES
    for strength in range(1, 5):
        weights[strength * 4] = weights[strength * 4 + 1] = 2.0 * strength
    model = (t.Grammar(LEXICON), t.fallback(weights, [0] * t.PATTERNS), -4.5)
    score = lambda text: t._score(model, text)
    assert score("I will kill you") >= t.THRESHOLD > max(score("I will not kill you"), score("they wrote I will kill you"), score("I kill time"))
    assert score("You moron") >= t.THRESHOLD > max(score("You are not a moron"), score("He said moron"), score("You baker"))
    learned = [float(k) for k in range(t.FEATURES)]
    assert t.fallback(learned, [t.SUPPORT] * t.PATTERNS) == learned


def rows(n=400):
    out = []
    for k in range(n):
        bad = k % 8 == 0
        out.append((k, f"Some words {k} are here. {'You are a moron' if bad else 'You are a baker'}. " + f"filler{k % 50} text " * 5, int(bad)))
    return out


def test_learns_from_rows_not_held_out_and_scores_the_rest(spark):
    data = rows()
    docs = spark.createDataFrame([(k, x, 1.0, "en") for k, x, _ in data] + [(None, None, 1.0, "en"), (9000, "", 1.0, "en"), (0, data[0][1], 1.0, "en")], "doc_id long, text string, score double, lang string")
    flip = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y, 5) for k, _, y in data]  # labels of held-out rows are wrong, and must not be seen
    labels = spark.createDataFrame([*flip, (None, 1, 5), (0, None, 5)], "doc_id long, toxic int, text int")
    model = t.fit(docs, labels)
    assert "moron" in model["lexicon"] and "baker" not in model["lexicon"]
    got = t.score_documents(docs, model).collect()
    assert len(got) == len(data) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {k: y for k, _, y in data}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    kept = t.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(data) + 3 - sum(truth.values()) - 1


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    assert [r.predicted for r in t.score_documents(docs, model).collect()] == [0]
    assert t.score_documents(docs.limit(0), model).collect() == []
    assert t.fit(docs.limit(0), labels)["lexicon"] == {}


def test_stems_that_a_longer_term_replaces_go():
    assert t._most_specific({"lowei*": (3, 100.0), "lowe*": (3, 100.0), "low*": (1, 40.0), "moron": (3, 50.0), "moron*": (3, 50.0)}) == {"lowei*": (3, 100.0), "moron": (3, 50.0)}


def test_lexicon_counts_each_term_once_per_text(spark):
    texts = [(f"badstem{chr(97 + k % 20)}x other{k} badstem{chr(98 + k % 20)} same words", 1) for k in range(60)] + [(f"clean{k} same words other", 0) for k in range(300)]
    df = spark.createDataFrame([*texts, *texts[:30]], "text string, toxic int")  # copies of a text count once
    lexicon, *others = t.learn_lexicons(df)
    assert len(others) == t.FOLDS and all("badstem*" in x and x["badstem*"][1] < lexicon["badstem*"][1] for x in others)
    assert "badstem*" in lexicon and not any(x.startswith(("clean", "same", "words")) for x in lexicon)
    p = 60 / 360
    import math

    assert abs(lexicon["badstem*"][1] - 2 * 60 * math.log(1 / p)) < 1e-6
    words = spark.createDataFrame([(["abcd", "abc", "ab"],)], "words array<string>")
    assert words.select(t._stems("words", 3)).first()[0] == ["abc*", "abc*"]
