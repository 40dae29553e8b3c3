"""Fixed schemas of the nested documents, as DDL."""

ANNOTATION = "struct<text_id:string,text:string,code:array<string>>"
TYPED_ANNOTATION = "struct<text_id:string,text:string,code:array<string>,label_type:array<string>>"
RAW_ANNOTATION = "struct<text:string,codes:array<string>,start:bigint,`end`:bigint>"
SUBSENTENCE = "struct<subsentence_id:string,subsentence:string,most_close_annotation_span:string>"
SENTENCE = f"struct<sentence_id:string,sentence:string,most_close_annotation_span:string,subsentences:array<{SUBSENTENCE}>>"
PHRASE = "struct<type:string,text:string,start:int,`end`:int>"
CLAUSE = f"struct<text:string,start:int,`end`:int,phrases:array<{PHRASE}>>"
CHUNK_SENTENCE = f"struct<text:string,start:int,`end`:int,clauses:array<{CLAUSE}>>"
FIELD_RESULT = f"struct<input:string,sentences:array<{CHUNK_SENTENCE}>>"

RAW_CHAIN = f"pos bigint, context string, prev string, next string, annotations array<{RAW_ANNOTATION}>"
RAW_JSONL = f"context string, annotations array<{RAW_ANNOTATION}>"
MESSAGES = f"message string, message_id bigint, annotations array<{ANNOTATION}>"
TYPED_MESSAGES = f"message string, message_id bigint, annotations array<{TYPED_ANNOTATION}>"
SEGMENTED = f"message string, message_id bigint, sentences array<{SENTENCE}>"
LABELLED_LEVELED = "id string, text string, span string, labels array<struct<label:string,matched_codebook_label:string,level:string,code_id:string>>"
LABELLED_TYPED = "id string, text string, span string, labels array<struct<label:array<string>,label_type:array<string>>>"
CODEBOOK_NODES = "id string, type string, description array<string>"
CODEBOOK_EDGES = "source string, target string"
CODEBOOK_SHEET = "`CODE` string, `CODE DEFINITION` string, `SUB-CODE` string, `SUB-CODE DEFINITION` string"
NODE_INDEX = "level string, entry string"
LABEL_MAPPING = "raw string, matched_codebook_label string, level string"
INTENT_TYPES = "intent_type string, index string, label string, level string"
ALIAS_RULES = "target string, kind string, pattern string"
TOPICS = "topic string, word string"
CHUNKS = "id string, selected_labels array<string>, split string, field string, sent_no int, clause_no int, phrase_no int, type string, text string, start int, `end` int"
PHRASE_POOL = "phrase_text string, phrase_type string, occurrences bigint, doc_freq bigint, top_label_by_PMI string, top_label_PMI double, label_purity double, label_entropy double"
PHRASE_LABEL_EDGES = "phrase_text string, phrase_type string, label string, doc_cofreq bigint, pmi double"
CONFLICT_SAMPLES = "anchor_text string, anchor_label string, neighbor_text string, neighbor_label string, similarity double"
AMBIGUOUS_PAIRS = "label_A string, label_B string, count bigint, avg_similarity double, n_A bigint, n_B bigint, ratio_A double, ratio_B double"
DISAGREEMENT = "label string, avg_cross_label_rate double, n_items bigint"
GRAPH_NODES = "graph_id string, id string, label string, pos string, type string"
GRAPH_EDGES = "graph_id string, source string, target string, label string, dep string, weight double"
PREDICTIONS = "model string, id string, text string, true_label string, pred_label string, correct boolean"
TRAIN_LOG = "model string, epoch int, loss double, accuracy double, f1 double"
