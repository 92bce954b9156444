"""Declared schemas of the records that readers return."""

from __future__ import annotations

INSTANCE = (
    "_id string, domain string, sub_domain string, difficulty string, length string, question string, "
    "choice_A string, choice_B string, choice_C string, choice_D string, answer string, context string, text string, "
    "config map<string,string>"
)
NEEDLE_INSTANCE = (
    "_id string, domain string, sub_domain string, difficulty string, length string, questions array<string>, answers array<string>, "
    "question_depths array<string>, context string, secrets array<struct<key:string,value:string>>, original_question string, original_answer string"
)
#: As written: a box mixes numbers and its text, so all are read as strings.
LINE_BOX = "unique_id string, image_paths array<string>, bboxes array<array<array<string>>>"
BOX = "struct<x0:int,y0:int,x1:int,y1:int,text:string>"
LAYOUT_ELEMENT = (
    "struct<category_type:string,poly:array<double>,ignore:boolean,order:int,anno_id:int,text:string,"
    "line_with_spans:array<struct<category_type:string,poly:array<double>,text:string>>,"
    "attribute:struct<text_language:string,text_background:string,text_rotate:string>>"
)
LAYOUT_DOC = (
    f"layout_dets array<{LAYOUT_ELEMENT}>, extra struct<relation:array<string>>, "
    "page_info struct<page_attribute:struct<data_source:string,language:string,layout:string,special_issue:array<string>>,"
    "page_no:int,height:int,width:int,image_path:string>"
)
PAGE_TEXT = "page_id string, text string"
SCORE = "page_id string, cer double, bleu double"
MC_RESULT = (
    "split string, instance_id string, question string, choices map<string,string>, ground_truth string, prompt string, "
    "model_output string, extracted_answer string, correct boolean, num_images int, status string, error string"
)
NEEDLE_RESULT = (
    "split string, instance_id string, question_idx int, question string, ground_truth string, prompt string, model_output string, "
    "correct boolean, num_images int, status string, error string"
)
PIXELS = "image_id string, height int, width int, channels int, data array<int>"
OCR_ITEM = (
    "image_path string, image_name string, extraction_level string, item_count int, polys array<array<array<double>>>, "
    "texts array<string>, confidences array<double>"
)
