"""Fixed values that results depend on: names, marks and patterns of the forum corpus."""

from __future__ import annotations

# The boards that the corpus keeps.
BOARDS = (
    "memes", "dankmemes", "adviceanimals", "me_irl", "memeeconomy", "copypasta", "dogelore", "shitposting",
    "okbuddyretard", "2meirl4meirl", "wholesomememes", "comedyheaven", "starterpacks", "surrealmemes", "bonehurtingjuice",
)
# Texts that stand for an absent one.
REMOVED = ("", "[deleted]", "[removed]")
# Patterns, in the form that Java, Python and RE2 read alike.
URL = r"(?i)https?://\S+|www\.[^\s.][^\s]*"
AROUND_LINKS = " \n\t[]()<>-:;,.!"
MARKDOWN_IMAGE = r"!\[([^\]]*)\]\([^)]*\)"
HTML_IMAGE = r"(?i)<img\b[^>]*>"
IMAGE_URL = r"(?i)https?://[^\s)]+\.(?:png|jpe?g|gif|webp)(?:\?[^\s)]*)?"
IMAGE_PLACEHOLDER = r"(?i)(?:!gif|!img|\[?image:\s*(?:img|gif)\]?)"
MEDIA_SOURCE = r"(?i)(?:i\.redd\.it|i\.imgur\.com|reddit\.com/gallery|v\.redd\.it|\.(?:png|jpe?g|gif|webp)(?:\?|$))"
BOT_FOOTER = r"(?i)i am a bot,? and this action was performed automatically|please contact the moderators of this subreddit if you have any questions"
LINK = r"(?i)https?://|www\.|(?:reddit|imgur)\.com/"
SPAM = (
    r"(?i)i am a bot|this action was performed automatically|your (?:post|submission) has been removed|"
    r"please contact the moderators|click here to|subscribe to my|buy (?:cheap|now)|"
    r"search engine optimization|home improvement tips|car buying (?:tips|suggestions)|"
    r"web hosting on the cheap|health benefits of|heart healthy mix|"
    r"(?:visit|check out) my (?:website|store|channel)"
)
TRAIN_LINE = r"step (\d+) loss ([\d.]+) lr ([\deE+.-]+) norm ([\deE+.-]+) seconds ([\d.]+)"
VALIDATION_LINE = r"validation step (\d+) loss ([\d.]+)"
# Phrase families and their patterns.
FAMILIES = {
    "doge": r"(?i)\bdoge\b", "pepe": r"(?i)\bpepe\b", "harambe": r"(?i)\bharambe\b", "stonks": r"(?i)\bstonks\b",
    "big_chungus": r"(?i)\bbig chungus\b", "among_us": r"(?i)\bamong us\b|\bamogus\b", "nobody": r"(?i)\bnobody\s*:",
    "this_is_fine": r"(?i)\bthis is fine\b", "me_irl": r"(?i)\bme[_ ]irl\b", "bro_really_thought": r"(?i)\bbro really thought\b",
}
# Words that a phrase may not both begin and end with.
STOP = tuple("the and for with that this from have you your are was what when where how why they them our not but all out can one two".split())
# Bounds of the training time, and the token counts of a step and a window.
TIME_START, TIME_END = 1293840000, 1609459199
STEP_TOKENS, WINDOW, STRIDE = 262144, 1025, 1024
YEAR_SECONDS = 31557600
