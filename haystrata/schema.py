"""Exchange formats and normalised tables, as Spark DDL."""

FUNCTION = "name string,start_line int,end_line int,start_byte int,end_byte int,global_start_line bigint,global_end_line bigint,global_start_byte bigint,global_end_byte bigint,code_ratio double"
NEEDLE = f"{FUNCTION},path string,description string"
SEED = "repo string,commit_sha string,entrypoint_path string,topic string"
REPO = ",".join(x.replace(" ", ":", 1) for x in SEED.split(","))


def _struct(ddl: str) -> str:
    return "struct<" + ",".join(x.replace(" ", ":", 1) for x in ddl.split(",")) + ">"


DATASET = f"map<string,array<struct<{REPO},content:map<string,string>,dependency:map<string,array<string>>,functions:map<string,array<{_struct(FUNCTION)}>>,needles:array<{_struct(NEEDLE)}>>>>"
SEEDS = f"map<string,array<{_struct(SEED)}>>"
GO_DEPENDENCY = "name string, repoName map<string,array<string>>"
ANNOTATION = "repo string, name string, prompt string, raw_annotation string, annotation string"
TASK = "repo string, name string, language string, path string, position_ratio double, description string, instruction string, template string, code_context string, needle_token_start int, needle_token_end int, code_context_ntokens int"
OUTPUT = TASK + ", output array<string>"
CRAWL = "repo_name string, repo_size bigint, repo_owner string, repo_url string, commit_sha string, last_modified_time timestamp, content map<string,string>"
EVAL = "repo string, name string, needle_position double, is_best_similar boolean, best_similar_score double, best_target string, position struct<token_start:int,token_end:int>"
# Line-comment signs and file suffixes by language.
COMMENT_SIGN = {"python": "#", "java": "//", "typescript": "//", "rust": "//", "cpp": "//", "go": "//"}
SUFFIXES = {"python": [".py"], "go": [".go"], "cpp": [".cpp", ".hpp", ".cc", ".hh", ".cxx", ".hxx", ".c", ".h"], "java": [".java"], "typescript": [".ts", ".js"], "rust": [".rs"]}
