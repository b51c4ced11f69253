"""Word lists of the bibliography rules, and settings that replace them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Name particles.
PARTICLES = frozenset(
    "de da di von zu van du des del della la le der af st. saint st dom do das dos of al el dei tot thoe aw na sri phra si shri lo no op lopes gonzalez vom castro y d ting".split()
)
# Name suffixes.
SUFFIXES = frozenset("sr. jr. sr jr senior junior iii iv v vi vii viii ix x the second third fourth fifth sixth seventh eighth ninth tenth great".split())
# Words kept in lower case inside venue names.
UNCAPS = frozenset("and or of the de in on for with to".split())
# Address codes.
ADDRESSES = tuple(
    """AL AK AS AZ AR CA CO CT DE DC FL GA GU HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND MP OH OK OR PA PR RI SC SD
    TN TX UT VT VA VI WA WV WI WY UK ON RU CH USA FR AU IT""".split()
)
# Fields that are kept.
FIELDS = tuple(
    "ENTRYTYPE ID address author booktitle chapter editor force howpublished institution journal number organization pages publisher school series title type volume year".split()
)
# Characters that don't count when words are compared.
MARKS = ",.!?'\"{}-\\:()[]+/*"
# Words whose capitals are kept; sites with more give their own list (sources.bibtex.load_settings reads one).
CAPS = tuple(
    """arXiv bioRxiv PsyArXiv SoftwareX PLoS BMC EEG CNS fMRI COSYNE eLife IEEE ACM iPerception NeuroImage NeuroReport NMR OpenAI USA NIPS NeurIPS AISTATS ICML
    A B C D E F G H I J K L M N O P Q R S T U V W X Y Z II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII IX XX""".split()
)


@dataclass(frozen=True)
class Settings:
    """Lists and alias dictionaries (lower-case original to canonical) of a site."""

    caps: tuple[str, ...] = CAPS
    addresses: tuple[str, ...] = ADDRESSES
    journals: dict[str, str] = field(default_factory=dict)
    publishers: dict[str, str] = field(default_factory=dict)
    places: dict[str, str] = field(default_factory=dict)
