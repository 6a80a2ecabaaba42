import random
import re

from siftwright.llm import leak, residue

WORDS = "alba bosco conte duna erba fiume grano isola lago monte notte orto ponte riva sale torre uva valle zolla arco".split()


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("aeiou") + str(rng.randrange(30)) for _ in range(n))


def leaks(spark, texts, passages):
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame(passages, "item_id bigint, passage string")
    return leak.find_leaks(docs, items, spark)


def test_leaks(spark):
    p, q = passage(1), passage(2)
    w = p.split()
    changed = list(w)
    for i in range(6, len(w), 9):
        changed[i] = "altro"
    added = []
    for i, t in enumerate(w):
        added += ["poi", t] if i % 8 == 7 else [t]
    texts = [
        (1, "Prima. " + p + " Dopo."), (2, p.upper().replace(" ", " \n ")), (3, " ".join(w[20:38])), (4, " ".join(changed)), (5, " ".join(added)),
        (6, " ".join(w[20:28])), (7, passage(9)), (8, None), (9, ""), (10, q + "\n\n" + p), (11, "x " * 40_000 + p), (12, ", ".join(w)),
        (13, re.sub(r"(\w{3})(\w+)", r"\1-\n\2", p)), (None, p), (1, p),
    ]
    got = {(r.doc_id, r.item_id) for r in leaks(spark, texts, [(100, p), (200, q), (300, "due parole")]).collect()}
    assert got == {(d, 100) for d in (1, 2, 3, 4, 5, 10, 11, 12, 13)} | {(10, 200)}
    assert leaks(spark, [], [(100, p)]).collect() == [] and leaks(spark, texts, []).collect() == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    texts = [(i, passage(100) + " " + passage(i)) for i in range(30)]
    items = [(i, passage(i)) for i in range(30)]
    once = {(r.doc_id, r.item_id) for r in leaks(spark, texts, items).collect()}
    df = spark.createDataFrame(items, "item_id bigint, passage string")
    parts = list(leak.blocks(df, 400))
    assert len(parts) > 1 and sum(map(len, parts)) == 30
    monkeypatch.setattr(leak.blocks, "__defaults__", (400,))
    assert {(r.doc_id, r.item_id) for r in leaks(spark, texts, items).collect()} == once == {(i, i) for i in range(30)}


def test_leaked_lines_are_removed(spark):
    p = passage(5)
    docs = spark.createDataFrame([(1, f"Titolo uno\n{p}\nFine del testo"), (2, "niente")], "doc_id bigint, text string")
    found = leaks(spark, [(1, f"Titolo uno\n{p}\nFine del testo")], [(7, p)])
    assert [tuple(r) for r in leak.remove_leaks(docs, found).collect()] == [(1, "Titolo uno\nFine del testo")]


def test_every_copy_of_a_passage_is_removed(spark):
    p = passage(5)
    w = p.split()
    text = f"Prima riga del testo, {p.upper()} e poi ancora. Inizio: {' '.join(w[10:32])}, fine.\nAltro: {p}"
    docs = spark.createDataFrame([(1, text), (2, f"Una riga sola {p} senza fine")], "doc_id bigint, text string")
    found = leaks(spark, [(r.doc_id, r.text) for r in docs.collect()], [(7, p)])
    assert {r.doc_id: r.text for r in leak.remove_leaks(docs, found).collect()} == {
        1: "Prima riga del testo, e poi ancora. Inizio: fine.\nAltro:", 2: "Una riga sola senza fine"
    }


def templates(n, rng):
    """Passages put together from a few phrases that all share, so hardly any word is particular to one."""
    phrases = [" ".join(rng.choice(WORDS) + rng.choice("ae") for _ in range(4)) for _ in range(150)]
    return [" ".join(rng.choice(phrases) for _ in range(20)) for _ in range(n)]


def test_altered_stretches_of_eighteen_words(spark):
    rng = random.Random(3)
    items = list(enumerate(templates(120, rng)))
    index = leak.PassageIndex(items)
    assert not any(index.particular[5])
    w = items[5][1].split()
    x = w[11:29]
    one, three, fifth = list(x), list(x), list(w)
    one[8] = three[4] = three[9] = three[14] = "altro"
    fifth[4::5] = ["altro"] * len(fifth[4::5])
    added = " ".join([*x[:6], "poi", *x[6:12], "anche", *x[12:]])
    frame = "Qui comincia la lezione di ieri. {} Qui finisce la lezione di oggi."
    texts = [(i, frame.format(t if isinstance(t, str) else " ".join(t))) for i, t in enumerate((one, three, fifth, added, w[11:19]))]
    assert {(r.doc_id, r.item_id) for r in leaks(spark, texts, items).collect()} == {(i, 5) for i in range(4)}


RESIDUE = [
    "Gentile {{ nome }},", "Benvenuto, %s!", "Pagina di [TITOLO_PAGINA]", "la [object Object] bassa", "Autore: undefined", "nei %COMUNE% giorni",
    "il ${autore} lesse", "il #{anno} testo", "il $!body testo", "vidi <%= materia %> ieri", "[[comune]] piccolo", "@@ANNO@@ della bottega",
    "studiò __DOCENTE__ la mappa", "a &lt;comune&gt; seconda", "forme {0} proposte", "per {% block date %} tutti", "(inserire qui: docente) di confine",
    "Lorem ipsum custolor viem lolculus", "Testo segnaposto da sostituire. Testo segnaposto da sostituire.", "TODO: scrivere questo paragrafo",
    "asdf bla prova qwerty prova xxx", "Cerait cazirit zostrisae gunfilem minpesit nuscuor pasis cutruem nuscuor binreus lebiit.",
    "404 Not Found", "Errore 503 - Servizio non disponibile", "Traceback (most recent call last):", "Seite nicht gefunden (404)",
    "Spiacenti, la pagina che cerchi non esiste o è stata spostata.", "KeyError: 'body'", "Please enable JavaScript to continue.",
    "Il tuo browser ha JS disattivato. Attivalo.", "Veuillez activer JavaScript pour continuer.", "Active JavaScript en su navegador.",
]
CONTENT = [
    "In informatica si scrive ${x} per inserire il valore di una variabile.", "L'insieme A = {1, 3, 5, 8} contiene solo numeri dispari.",
    "Nel modello di lettera le parentesi graffe, come in «{autore}», indicano il campo da compilare.", "A Velagna si tiene un corso di JavaScript per principianti.",
    "I grafici chiamano lorem ipsum il testo finto delle bozze.", "Il quesito chiede che cosa significa «errore 500 del server».", "La voce «segnaposto» indica la bozza.",
    "Quando la pagina cercata non esiste, spiega il notaio, il server risponde con il codice 404 e una breve frase.",
    "Completa lo schema: soggetto ____, verbo ____, complemento [entità].", "Il rimborso copre il 50% della spesa e il 25% del viaggio.",
    "Nota [1]: il racconto, cap. [II], p. [14]; il passo [...] è incompleto.", "La donna ______ il libro (...) sul tavolo …………", "", "   ",
    "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani et tertiam Celtae.",
]


def flagged_ids(spark, texts, sources=residue.WIDELY, **kw):
    """Positions of the texts that come out when each stands in so many sources."""
    rows = [(1000 * k + i, f"s{k}", t) for k in range(sources) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = {r.doc_id for r in residue.find_residue(df, spark, **kw)[0].collect()}
    assert found == {1000 * k + i % 1000 for k in range(sources) for i in found}  # copies share their fate
    return {i % 1000 for i in found}


def test_residue_rules(spark):
    assert flagged_ids(spark, RESIDUE) == set(range(len(RESIDUE)))
    assert flagged_ids(spark, CONTENT) == set()


def test_messages_must_recur(spark):
    messages = [t for t in RESIDUE if not any(certain for _, certain, _ in residue.units(t))]
    assert 12 < len(messages) < len(RESIDUE)
    assert flagged_ids(spark, messages, sources=residue.WIDELY - 1) == set()
    assert flagged_ids(spark, messages, sources=1, widely=1) == set(range(len(messages)))


def test_residue_in_documents(spark):
    texts = [(i, "s", t) for i, t in enumerate(RESIDUE)] + [(100 + i, None, t) for i, t in enumerate(CONTENT)]
    texts += [(200, "s", None), (None, "s", RESIDUE[0]), (201, "s", "parola " * 30_000 + "\n" + RESIDUE[0]), (202, "a", "Coming soon"), (0, "s", RESIDUE[0])]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id bigint, source string, text string, h int")
    flagged, groups = residue.find_residue(df, spark)
    found = {r.doc_id for r in flagged.collect()}
    assert {0, 6, 201} <= found <= {*range(len(RESIDUE)), 201}
    more = df.unionByName(spark.createDataFrame([(300 + i, f"s{i}", "Prima parte.\n  coming SOON ", 1) for i in range(3)], df.schema))
    assert {202, 300, 301, 302} <= {r.doc_id for r in residue.find_residue(more, spark)[0].collect()}
    assert residue.find_residue(df.limit(0), spark)[0].collect() == []
    assert {r.kind for r in groups.collect()} == {"placeholder", "filler"}


def test_spelling_of_messages(spark):
    texts = [
        "JS is required for this page", "Abilita JS", "Abilita JS!", "Bitte aktivieren Sie Skripte", "Errore 1045 - accesso al database", "Fehler 12: kein Zugriff",
        "410 - Gone", "prova prova prova prova", "test foo bar test", "aaa aaa aaa aaa", "Errore  404 - Risorsa assente", "Errore\u00a0404 - Risorsa assente",
        "La sessione &egrave; scaduta", "La sessione e\u0300 scaduta", "[E] di turno", "%A% di turno", "scrivi %12$s oggi",
        "cerait cazirit mola zostrisae gunfilem minpesit pane nuscuor pasis cutruem",
        "This site requires JavaScript.", "JavaScript must be enabled to view this site.", "Questo sito richiede JavaScript", "404 - File Not Found",
        "502 Bad Gateway nginx", "The requested URL was not found on this server.", "Your session has expired. Please log in again.",
        "La pagina che stai cercando non esiste.", "Dear [Your Name],", "• Da completare.", "Errore 301 - risorsa spostata altrove",
    ]
    assert flagged_ids(spark, texts) == set(range(len(texts)))


def test_texts_about_messages(spark):
    texts = [
        "Use the %s format to print strings in C.", "In Mustache one writes {{name}} to insert the field.",
        "La variabile undefined compare in JavaScript quando manca un valore", "Chi studia PHP incontra la sintassi <%= nome %> già nel primo capitolo.",
        "Il campo «{{ nome }}» va riempito a mano.", "Lorem ipsum si chiama il testo finto: significa poco.",
    ]
    assert flagged_ids(spark, texts) == set()


def test_fields_hold_what_is_looked_for_first():
    samples = [t for t in RESIDUE if any(f in residue.FIELDS for f, _, _ in residue.units(t))]
    for name, (_, needs, pattern) in residue.FIELDS.items():
        needs = (needs,) if isinstance(needs, str) else needs
        for t in [*samples, "[Your Name]", "(INSERISCI titolo)", "<NOME>", "[NOME]", "{nome}", "[[x]]", "%A%"]:
            assert all(any(n in m[0].lower() for n in needs) for m in residue.re.finditer(pattern, t)), name
