"""Text from which profiles of prose are measured: article 1 of the Universal Declaration of Human Rights in languages of several scripts, and paragraphs of our own."""

from __future__ import annotations

# The article as published.
PROSE = {
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "ar": "يولد جميع الناس أحرارًا متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميرًا وعليهم أن يعامل بعضهم بعضًا بروح الإخاء.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
}


# Text of our own, written for this purpose, in the languages whose function words are known.
KNOWN = {
    "en": 'The second half of the evening began quietly, and for a while nobody in the room seemed to notice that the music had changed. She stood near the door with her coat still on and watched the people who were talking at the bar. When the first voices came in, they were so soft that you could have taken them for the wind outside. He told me afterwards that he had never planned it like that; it was only because the other record was missing that he took this one, and then it fitted so well that he left it in. We walked home along the river, and I remember that we did not speak much, since each of us was still listening to what we had heard. It is strange how some nights stay with you for years while others are gone by the next morning.',
    "de": 'Die zweite Hälfte des Abends begann leise, und eine Zeit lang schien niemand im Raum zu bemerken, dass sich die Musik geändert hatte. Sie stand noch im Mantel an der Tür und sah den Leuten zu, die an der Theke miteinander sprachen. Als die ersten Stimmen einsetzten, waren sie so weich, dass man sie für den Wind hätte halten können. Er hat mir später erzählt, dass er das nie so geplant habe; nur weil die andere Platte fehlte, habe er diese genommen, und dann passte sie so gut, dass er sie darin ließ. Wir gingen am Fluss entlang nach Hause, und ich weiß noch, dass wir nicht viel redeten, weil jeder von uns noch dem nachhörte, was gewesen war.',
    "es": 'La segunda mitad de la noche empezó en voz baja, y durante un rato nadie en la sala pareció darse cuenta de que la música había cambiado. Ella estaba junto a la puerta, todavía con el abrigo puesto, y miraba a la gente que hablaba en la barra. Cuando entraron las primeras voces, eran tan suaves que se las podía confundir con el viento de fuera. Él me contó después que nunca lo había planeado así; solo porque faltaba el otro disco tomó este, y luego encajó tan bien que lo dejó. Volvimos a casa por la orilla del río, y recuerdo que no hablamos mucho, porque cada uno seguía escuchando lo que habíamos oído.',
    "fr": "La seconde moitié de la soirée commença doucement, et pendant un moment personne dans la salle ne sembla remarquer que la musique avait changé. Elle se tenait près de la porte, encore en manteau, et regardait les gens qui parlaient au bar. Quand les premières voix sont entrées, elles étaient si douces qu'on aurait pu les prendre pour le vent du dehors. Il m'a raconté plus tard qu'il ne l'avait jamais prévu ainsi ; c'est seulement parce que l'autre disque manquait qu'il a pris celui-ci, et puis il allait si bien qu'il l'a laissé. Nous sommes rentrés le long de la rivière, et je me souviens que nous ne parlions pas beaucoup, car chacun de nous écoutait encore ce que nous avions entendu.",
}


def structures(text: str) -> dict[str, str]:
    """What is no prose, made by rule from the words of a text: strings of names, of keywords and of tags, backward and repeated text, lists, tables, records."""
    marks = ".,;:!?،。、，।"
    words = [w.strip(marks) for w in text.translate({ord(c): " " for c in marks}).split()]
    if len(words) < 8:  # no blanks between words
        words = [text[k : k + 3].strip(marks) for k in range(0, len(text), 3)]
    names = [w[:1].upper() + w[1:] for w in words if len(w) > 3] or words
    low = [w.lower() for w in words if len(w) > 3] or words
    twos = [f"{a} {b}" for a, b in zip(names, names[1:])]
    return {
        "names": ", ".join(twos),
        "words": " ".join(low),
        "tags": " ".join(f"{a} 2025 {b}" if k % 12 == 5 else f"{a} {b}" for k, (a, b) in enumerate(zip((w.lower() for w in words), sorted(w.lower() for w in words)))),
        "backwards": text[::-1],
        "again": "\n".join([f"{low[0]}..."] * 12),
        "repeated": "\n".join([text[: len(text) // 2] + "."] * 8),
        "keywords": ", ".join(low),
        "list": "\n".join(f"{k + 1}. {a} - {b}" for k, (a, b) in enumerate(zip(names, twos))),
        "menu": "\n".join(twos),
        "table": "\n".join(f"{a} | {b} | {17 * k % 100} | {k * 7.5}" for k, (a, b) in enumerate(zip(names, low))),
        "columns": "\n".join(f"{a}\t{b}\t{31 * k % 1000}\t{k * 3 % 24:02d}:{k * 7 % 60:02d}" for k, (a, b) in enumerate(zip(names, low))),
        "records": "\n".join(f'{{"{a}": "{b}", "id": {k * 977}}}' for k, (a, b) in enumerate(zip(low, names))),
        "log": "\n".join(f"2026-01-{k % 28 + 1:02d} {k % 24:02d}:{k * 7 % 60:02d}:00 [{a}] {b}={k * 13}" for k, (a, b) in enumerate(zip(names, low))),
    }
