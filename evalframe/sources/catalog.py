"""Fixed values of the domain: model sizes, task lists, known log issues.

All values below must equal the published ones for results to agree.
"""

from __future__ import annotations

# Model sizes, smallest first, with their flop-matched non-embedding parameter counts.
MODEL_PARAMETERS = {
    "2m": 2098048,
    "16m": 16780288,
    "53m": 56629632,
    "125m": 134228992,
    "244m": 262161280,
    "422m": 453009408,
    "1b": 1073784832,
    "2b": 2097218560,
    "4b": 3623973888,
    "8b": 8590102528,
    "27b": 28991404032,
    "128b": 137440272384,
}
MODEL_SIZES = list(MODEL_PARAMETERS)
REFERENCE_MODEL_SIZE = "128b"
ASSESSOR_SIZES = ["small", "base", "large"]
TRUNCATION_SIDES = ["left", "right"]

# The "lite" task list.
LITE_TASKS = """
auto_debugging bbq_lite_json code_line_description conceptual_combinations conlang_translation emoji_movie
formal_fallacies_syllogisms_negation hindu_knowledge known_unknowns language_identification linguistics_puzzles
logic_grid_puzzle logical_deduction misconceptions_russian novel_concepts operators
parsinlu_reading_comprehension play_dialog_same_or_different repeat_copy_logic strange_stories strategyqa
symbol_interpretation vitaminc_fact_verification winowhy
""".split()
PIPELINE_TEST_SIZE = 10

# The full task list.
FULL_TASKS = """
abstract_narrative_understanding abstraction_and_reasoning_corpus anachronisms analogical_similarity
analytic_entailment arithmetic ascii_word_recognition authorship_verification auto_categorization auto_debugging
bbq_lite bbq_lite_json bias_from_probabilities boolean_expressions bridging_anaphora_resolution_barqa causal_judgment
cause_and_effect checkmate_in_one chess_state_tracking chinese_remainder_theorem cifar10_classification
code_line_description codenames color com2sense common_morpheme conceptual_combinations conlang_translation
context_definition_alignment coqa_conversational_question_answering crash_blossom crass_ai cryobiology_spanish
cryptonite cs_algorithms cycled_letters dark_humor_detection date_understanding disambiguation_qa
discourse_marker_prediction disfl_qa diverse_social_bias dyck_languages dynamic_counting elementary_math_qa
emoji_movie emojis_emotion_prediction empirical_judgments english_proverbs english_russian_proverbs entailed_polarity
entailed_polarity_hindi epistemic_reasoning evaluating_information_essentiality fact_checker factuality_of_summary
fantasy_reasoning few_shot_nlg figure_of_speech_detection forecasting_subquestions
formal_fallacies_syllogisms_negation gem gender_inclusive_sentences_german gender_sensitivity_chinese
gender_sensitivity_english general_knowledge geometric_shapes goal_step_wikihow gre_reading_comprehension
hhh_alignment high_low_game hindi_question_answering hindu_knowledge hinglish_toxicity human_organs_senses hyperbaton
identify_math_theorems identify_odd_metaphor implicatures implicit_relations intent_recognition
international_phonetic_alphabet_nli international_phonetic_alphabet_transliterate intersect_geometry
irony_identification kanji_ascii kannada key_value_maps known_unknowns language_games language_identification
linguistic_mappings linguistics_puzzles list_functions logic_grid_puzzle logical_args logical_deduction
logical_fallacy_detection logical_sequence mathematical_induction matrixshapes metaphor_boolean metaphor_understanding
minute_mysteries_qa misconceptions misconceptions_russian mnist_ascii modified_arithmetic moral_permissibility
movie_dialog_same_or_different movie_recommendation mult_data_wrangling multiemo multistep_arithmetic
muslim_violence_bias natural_instructions navigate nonsense_words_grammar novel_concepts object_counting odd_one_out
operators paragraph_segmentation parsinlu_qa parsinlu_reading_comprehension penguins_in_a_table periodic_elements
persian_idioms phrase_relatedness physical_intuition physics physics_questions play_dialog_same_or_different
polish_sequence_labeling presuppositions_as_nli program_synthesis protein_interacting_sites
python_programming_challenge qa_wikidata question_answer_creation question_selection real_or_fake_text
reasoning_about_colored_objects repeat_copy_logic rephrase riddle_sense roots_optimization_and_games ruin_names
salient_translation_error_detection scientific_press_release self_awareness self_evaluation_courtroom
self_evaluation_tutoring semantic_parsing_in_context_sparc semantic_parsing_spider sentence_ambiguity
similarities_abstraction simp_turing_concept simple_ethical_questions simple_text_editing snarks social_iqa
social_support spelling_bee sports_understanding squad_shifts strange_stories strategyqa subject_verb_agreement sudoku
sufficient_information suicide_risk swahili_english_proverbs swedish_to_german_proverbs symbol_interpretation taboo
talkdown temporal_sequences tense text_navigation_game timedial topical_chat tracking_shuffled_objects truthful_qa
twenty_questions understanding_fables undo_permutation unit_conversion unit_interpretation
unnatural_in_context_learning unqover vitaminc_fact_verification web_of_lies what_is_the_tao which_wiki_edit winowhy
word_problems_on_sets_and_graphs word_sorting word_unscrambling yes_no_black_white
""".split()
NOT_IN_FULL_LIST = ["training_on_test_set"]

# Tasks with known issues in their logs.
FAULTY_TARGETS = ["arithmetic"]
NONBINARY_SCORES = ["emojis_emotion_prediction"]
UNRECOVERABLE_SCORES = ["context_definition_alignment"]
DIFFERENT_SAMPLES_MODELWISE = ["periodic_elements"]
WITHOUT_TARGET = """
abstraction_and_reasoning_corpus coqa_conversational_question_answering cycled_letters high_low_game
multistep_arithmetic muslim_violence_bias program_synthesis python_programming_challenge question_answer_creation
roots_optimization_and_games self_awareness self_evaluation_courtroom self_evaluation_tutoring spelling_bee
squad_shifts sudoku taboo text_navigation_game truthful_qa twenty_questions word_problems_on_sets_and_graphs
yes_no_black_white
""".split()
DIFFERENT_SAMPLES_SHOTWISE = """
anachronisms analogical_similarity analytic_entailment arithmetic authorship_verification causal_judgment
cause_and_effect code_line_description common_morpheme conceptual_combinations crash_blossom crass_ai
cryobiology_spanish cs_algorithms dark_humor_detection date_understanding disambiguation_qa
discourse_marker_prediction dyck_languages emoji_movie emojis_emotion_prediction empirical_judgments
english_proverbs english_russian_proverbs entailed_polarity entailed_polarity_hindi
evaluating_information_essentiality fact_checker fantasy_reasoning figure_of_speech_detection general_knowledge
geometric_shapes gre_reading_comprehension hhh_alignment hindu_knowledge hinglish_toxicity human_organs_senses
identify_math_theorems identify_odd_metaphor implicatures implicit_relations intent_recognition
international_phonetic_alphabet_nli irony_identification kanji_ascii kannada key_value_maps known_unknowns
logic_grid_puzzle logical_args logical_deduction logical_sequence mathematical_induction metaphor_boolean
metaphor_understanding minute_mysteries_qa misconceptions moral_permissibility movie_recommendation navigate
nonsense_words_grammar novel_concepts odd_one_out penguins_in_a_table persian_idioms phrase_relatedness
physical_intuition physics presuppositions_as_nli riddle_sense ruin_names salient_translation_error_detection
sentence_ambiguity similarities_abstraction simple_ethical_questions snarks social_support sports_understanding
strange_stories suicide_risk swahili_english_proverbs swedish_to_german_proverbs symbol_interpretation
temporal_sequences understanding_fables undo_permutation unit_interpretation what_is_the_tao which_wiki_edit
""".split()
ISSUES = {
    "different_samples_modelwise": DIFFERENT_SAMPLES_MODELWISE,
    "without_target": WITHOUT_TARGET,
    "unrecoverable_faulty_scores": UNRECOVERABLE_SCORES,
    "faulty_targets": FAULTY_TARGETS,
    "nonbinary_scores": NONBINARY_SCORES,
    "different_samples_shotwise": DIFFERENT_SAMPLES_SHOTWISE,
}
# Only these three lists make a task unusable.
EXCLUDING_ISSUES = ["different_samples_modelwise", "without_target", "unrecoverable_faulty_scores"]
FAULTY_TASKS = [task for issue in EXCLUDING_ISSUES for task in ISSUES[issue]]

# Tasks left out of metric reports because of contamination.
CONTAMINATED_TASKS = """
unit_conversion geometric_shapes minute_mysteries_qa strategyqa penguins_in_a_table similarities_abstraction
kanji_ascii emoji_movie color checkmate_in_one
""".split()

# Tasks too large to train on directly.
TOO_LARGE_TASKS = {"dyck_languages": "OOM", "intersect_geometry": "OOM"}

# Price in dollars per 1000 tokens, and the configured output length.
PRICES_PER_1000_TOKENS = {"Ada": 0.0004, "Babbage": 0.0005, "Curie": 0.0020, "Davinci": 0.0200}
OUTPUT_TOKENS_PER_ROW = 64


def resolve_tasks(
    tasks: str | list[str] | None,
    available: list[str] | None = None,
    exclude_faulty: bool = True,
) -> list[str]:
    """A task list by name, or a copy of an explicit one, without the faulty tasks.

    ``None`` means every directory of the log folder (``available``) but the one
    that is no task; ``"paper-full"`` the full list; ``"paper-lite"`` the lite
    list; ``"pipeline-test"`` its head.
    """
    if tasks is None:
        if available is None:
            raise ValueError("without a list, tasks are the directories of the log folder; none were given")
        names = [t for t in available if t not in NOT_IN_FULL_LIST]
    elif tasks == "paper-full":
        names = list(FULL_TASKS)
    elif tasks == "paper-lite":
        names = list(LITE_TASKS)
    elif tasks == "pipeline-test":
        names = LITE_TASKS[:PIPELINE_TEST_SIZE]
    elif isinstance(tasks, (list, tuple)):
        names = list(tasks)
    else:
        raise ValueError(f"no task list is called {tasks!r}")
    return [t for t in names if not (exclude_faulty and t in FAULTY_TASKS)]
