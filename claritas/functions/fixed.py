"""Texts, codes and patterns that results depend on byte for byte."""

# --- answer sheets -----------------------------------------------------------------------

CRITERIA_BY_THEME = {
    "Choix de l'information": ["CI3", "CI4", "CI5", "CI6", "CI8"],
    "Choix des mots": [
        "CPM2", "CPM3", "CPM4", "CPM5", "CPM6", "CPM8", "CPM9",
        "CPM16", "CPM17", "CPM18", "CPM19", "CPM20", "CPM21",
    ],
    "Construction des phrases": ["CPM1", "CPM7", "CPM10", "CPM11", "CPM12", "CPM13", "CPM14", "CPM15"],
    "Illustrations": ["I1", "I2"],
    "Qualité globales": ["CA1", "CA2", "CA3", "CA4", "CA5", "CA6", "CA7", "CA8"],
}
QUALITY_THEME = "Qualité globales"
RULE_TYPE = "ETR"
QUALITY_TYPE = "global quality"
CRITERION_WEIGHTS = {
    "CI3": 2, "CI4": 6, "CI5": 2, "CI6": 2, "CI8": 2,
    "CPM1": 6, "CPM2": 6, "CPM3": 6, "CPM4": 2, "CPM5": 6, "CPM6": 4, "CPM7": 2,
    "CPM8": 2, "CPM9": 2, "CPM10": 4, "CPM11": 2, "CPM12": 4, "CPM13": 4, "CPM14": 4,
    "CPM15": 2, "CPM16": 2, "CPM17": 2, "CPM18": 2, "CPM19": 2, "CPM20": 2, "CPM21": 2,
    "I1": 4, "I2": 4,
}
CRITERIA = [
    "CI3", "CI4", "CI5", "CI6", "CI8",
    "CPM1", "CPM2", "CPM3", "CPM4", "CPM5", "CPM6", "CPM7", "CPM8", "CPM9", "CPM10", "CPM11",
    "CPM12", "CPM13", "CPM14", "CPM15", "CPM16", "CPM17", "CPM18", "CPM19", "CPM20", "CPM21",
    "I1", "I2", "CA1", "CA2", "CA3", "CA4", "CA5", "CA6", "CA7", "CA8",
]
NOT_APPLICABLE = "Non Applicable"
ANSWER_SCORES = {"Oui": 1, "Non": 0, "Partiellement": 1}

# --- text marks and patterns -------------------------------------------------------------

ANSWER_MARK = "@@@"
INPUT_PREFIX = "### Input:"
OUTPUT_PREFIX = "### Output:"
BRACKET_TOKENS = r"-?.?LRB.?-?|-?.?RRB.?-?"
IGNORE_INDEX = -100

# --- prompts -----------------------------------------------------------------------------

GUIDELINES = [
    "Donne uniquement les informations essentielles. Évite la surcharge d’informations.",
    "Présente les informations dans un ordre logique et facile à suivre.",
    "Mets en avant l’information principale dès le début.",
    "Regroupe ensemble les informations qui parlent du même sujet.",
    "Répète les informations importantes si cela aide à la compréhension.",
    "Utilise des phrases courtes et simples.",
    "Choisis des mots faciles à comprendre.",
    "Explique clairement les mots difficiles, et répète l’explication si besoin.",
    "Utilise un langage adapté aux personnes concernées.",
    "Emploie le même mot pour parler de la même chose tout au long du texte.",
    "Évite les idées abstraites, les métaphores et les comparaisons complexes.",
    "Ne recours pas à des mots étrangers ou peu connus sans explication.",
    'Ne pas utiliser de mots contractés ou de style "texto".',
    "Adresse-toi directement au lecteur, de manière claire et accessible.",
    "Veille à ce que les pronoms soient toujours clairs et non ambigus.",
    "Privilégie des formulations positives plutôt que négatives.",
    "Utilise la voix active autant que possible.",
    "Choisis une ponctuation simple.",
    "Utilise des puces ou des numéros pour les listes, plutôt que des virgules.",
    "Écris les nombres en chiffres (ex. : 1, 2, 3), pas en lettres.",
    "Explique les sigles dès leur première apparition.",
    "N’utilise pas d’abréviations non expliquées.",
    "Écris les dates en toutes lettres pour plus de clarté.",
    "Limite l’usage des pourcentages ou grands nombres, et explique-les simplement.",
    "N’utilise pas de caractères spéciaux inutiles.",
    "Utilise des exemples concrets pour illustrer les idées complexes.",
    "Privilégie des exemples issus de la vie quotidienne.",
]

PROMPT_OPENING = "Tu es un assistant chargé de rendre un texte plus clair et accessible."
PROMPT_REWRITE = "Réécris le texte ci-dessous en suivant les consignes suivantes :"
PROMPT_ONLY_TEXT = "Réponds uniquement par le texte réécrit, en français."
PROMPT_SHOTS_INTRO = "Voici une série de d'examples provenant de tâches proches de ce que tu dois faire :"
PROMPT_COMPLETE = "Maintenant, compléte l'example suivant en français."
# The next line has no break before the sentence on marks.
PROMPT_KEEP_AND_MARK = "Garde le contexte tel quel, n'ajoute ni titre ni section supplémentaire ni saut de ligne.Entoure ta réponse par des balises '@@@' comme dans les exemples précédents."
PROMPT_STEPS_INTRO = "Procède en suivant les étapes suivantes :"
PROMPT_STEP_1 = "1. Analyse le texte pour identifier ce qui peut être simplifié ou clarifié."
PROMPT_STEP_2 = "2. Note brièvement les points à améliorer (syntaxe, vocabulaire, structure...)."
PROMPT_STEP_3 = "3. Réécris le texte en appliquant les consignes suivantes :"
PROMPT_STEP_4 = "4. Vérifie que la version réécrite est plus claire, plus accessible et respecte bien toutes les consignes."
PROMPT_STEPS_END = "Commence par réfléchir étape par étape, puis termine en donnant la version finale du texte en français entourée par les balises '@@@'."
SHOT_HEADING = "### Exemple "
TASK_LABEL = "Tâche: "
INPUT_LABEL = "Entrée: "
OUTPUT_LABEL = "Sortie: "

# Wording of the early prototype: numbering from 0, own labels.
EARLY_SHOTS_INTRO = "\n\n Voici quelques exemples de transformation de texte en texte facile à lire et à comprendre.\n\n"
EARLY_HEADING = "Exemple "
EARLY_SOURCE_LABEL = "Texte original :\n"
EARLY_TARGET_LABEL = "Traduction en texte facile à lire et à comprendre :\n"
# Opening (the guideline list follows), closing, and a worked negative example of the prototype.
EARLY_OPENING = """
Le facile à lire et à comprendre (FALC) est une méthode qui a pour but de traduire un langage classique en langage compréhensible par tous. 
Le texte ainsi simplifié peut être compris par les personnes handicapées mentales, 
mais aussi par d’autres comme les personnes dyslexiques, malvoyantes, les personnes âgées, les personnes qui maîtrisent mal le français.

Voici des principes de clarté et d’accessibilité suivants pour que tu puisse rendre un texte facile à lire et à comprendre  :
"""
EARLY_CLOSING = """

 Réécris le texte suivant en prenant en compte touts les principes de clarté et d’accessibilité précédents. Garde le contexte tel quel, n'ajoute ni titre ni section supplémentaire ni saut de ligne. 

 Entoure ta réponse par des balises "@@@" comme dans les exemples précédents."""
EARLY_NEGATIVE_EXAMPLE = """Voici maintenant des exemples négatif de texte transformé en facile à lire et à comprendre. Ce sont des exemples qui ont été transformé en facile à lire et à comprendre de la mauvaise manière. Je veux que tu y fasse vraiment attention pour ne pas reproduire les mêmes erreurs que ces exemples négatifs. Voici les exemples :

Exemple négatif 0
Texte original :
Toujours avec son caddie, Léa se rend directement au rayon des œufs. Cela lui fait tout drôle d'être seule dans le magasin, même si ce n'est que pour quelques minutes. À cet instant, elle a vraiment l'impression d'être grande et elle est très fière. Comme elle fait souvent les courses avec sa mère, elle sait exactement où se trouvent les œufs et sait quoi prendre. Elle passe d'abord devant le lait avant de les trouver. Elle saisit une boîte et vérifie qu'aucun d'entre eux n'est cassé, comme sa mère le lui a montré. Tout est bon, elle pose la boîte avec précaution dans le caddie.

Texte mal transformé en facile à lire et à comprendre :
Léa va chercher les œufs. Elle est seule dans le magasin. Elle est fière. Elle sait où sont les œufs. Elle sait quoi prendre. Elle passe devant le lait. Elle prend une boîte d'œufs. Elle vérifie si les œufs sont cassés. Tout est bon. Elle met la boîte dans le caddie.

Explication des erreurs :
- Il aurait fallut mettre en avant l’information principale dès le début, à savoir que "Léa est heureuse" car elle est allée faire les courses comme une grande, et pas qu'elle est allée chercher des oeufs.
- Les pronoms ne sont pas assez clair. Dans le facile à lire et à comprendre négatif, les phrases commençent par "Elle" au lieu de "Léa". "Léa" aurait dû être utilisé pour que le locuteur ne se perde pas dans l'histoire.
- Il y a des informations qui sont inutiles, et qui n'apporte aucun changement à la compréhension de l'histoire : "Elle sait quoi prendre. Elle passe devant le lait.". Il aurait fallut supprimer cette partie. Il faut donc mieux compresser l'information.
- Les informations sont répétées: "Elle prend une boîte d'œufs.","Elle met la boîte dans le caddie". Une seule des deux phrases est suffisante pour la compréhension du texte.

Texte correctement transformé en facile à lire et à comprendre :
Léa est heureuse. « Super ! Je vais chercher les œufs, toute seule ! » Léa trouve les œufs très vite. Les œufs sont fragiles. Léa fait attention de ne pas casser les œufs.

"""

# --- result tables -----------------------------------------------------------------------

METRIC_ORDER = ["rouge1", "rouge2", "rougeL", "sari", "bertscore_f1", "srb", "compression_ratio", "novelty"]
