from importlib import util
from pathlib import Path

spec = util.spec_from_file_location("_llm_conftest", Path(__file__).with_name("conftest.py"))
module = util.module_from_spec(spec)
spec.loader.exec_module(module)
words = module.words
