"""Other names of the categories of biomedical metadata, and words without a meaning of their own."""

#: Common other names, from general knowledge.
ALIASES = {
    "model_organism": {
        "Human": ["homo sapiens", "h sapiens", "humans", "people", "persons", "patients", "volunteers", "mensch", "humain", "humano", "man", "men and women"],
        "Mouse/Rat": ["mouse", "mice", "rat", "rats", "murine", "rodent", "rodents", "mus musculus", "m musculus", "rattus norvegicus", "r norvegicus"],
        "Zebrafish": ["danio rerio", "d rerio", "zf"],
        "Drosophila melanogaster": ["drosophila", "fruit fly", "fruit flies", "vinegar fly", "fly"],
        "Caenorhabditis elegans": ["nematode", "nematodes", "roundworm", "worm", "worms"],
        "Saccharomyces cerevisiae": ["yeast", "budding yeast", "bakers yeast", "baker s yeast", "brewers yeast", "brewer s yeast"],
        "Escherichia coli": ["e coli", "coli bacteria"],
        "Arabidopsis thaliana": ["arabidopsis", "thale cress", "mouse ear cress"],
        "Plant": ["plants", "crops", "crop plant", "plant species"],
        "Cell Culture": ["cell line", "cell lines", "cultured cells", "cultured cell lines", "cells in culture", "in vitro cells", "in vitro"],
        "In Silico / Computational": ["in silico", "computational", "computer model", "computer simulation", "simulation", "no organism in silico"],
        "Other Mammal": ["other mammals", "another mammal", "mammal other", "non rodent mammal"],
        "Other Vertebrate": ["other vertebrates", "another vertebrate", "vertebrate other"],
        "Other Invertebrate": ["other invertebrates", "another invertebrate", "invertebrate other"],
        "Other Microbe": ["other microbes", "another microbe", "microbe other", "other bacteria", "other microorganism"],
        "Not Applicable / Review": ["not applicable", "review", "review article", "none review"],
        "Other": ["others", "other organism", "something else", "none of these"],
    },
    "primary_research_area": {
        "Biochemistry": ["biochem", "biological chemistry"],
        "Bioinformatics": ["bioinfo", "computational biology"],
        "Biophysics": ["biophys", "biological physics"],
        "Cancer Biology": ["oncology", "cancer research", "cancer", "tumour biology", "tumor biology"],
        "Cell Biology": ["cell bio", "cell biol", "cellular biology", "biology of the cell", "cytology"],
        "Clinical Trials": ["clinical trial", "clinical studies"],
        "Developmental Biology": ["dev bio", "development biology", "biology of development", "embryology"],
        "Ecology": ["ecological research", "eco"],
        "Epidemiology": ["epi", "epidemiological research"],
        "Evolutionary Biology": ["evo bio", "evolution", "biology of evolution"],
        "Genetics": ["genetic research", "heredity"],
        "Genomics": ["genome research", "genome science"],
        "Immunology": ["immuno", "immunological research", "immune biology"],
        "Microbiology": ["microbial biology", "microbio", "micro bio", "bacteriology"],
        "Molecular Biology": ["mol bio", "molecular bio"],
        "Neuroscience": ["neuro", "neurosciences", "neurobiology", "brain research", "brain science"],
        "Paleontology": ["palaeontology", "paleo", "fossil research"],
        "Pathology": ["patho", "pathological research"],
        "Pharmacology and Toxicology": ["pharm tox", "pharmacology", "toxicology", "pharmacology toxicology", "pharma tox"],
        "Physiology": ["physio", "physiological research"],
        "Plant Biology": ["botany", "plant science", "plant sciences", "plant bio"],
        "Public Health": ["population health", "community health"],
        "Scientific Communication and Education": ["science communication", "science education", "sci comm", "scicomm", "scientific communication"],
        "Structural Biology": ["structural bio", "struct bio"],
        "Synthetic Biology": ["synth bio", "synbio", "synthetic bio"],
        "Systems Biology": ["systems bio", "sys bio", "system biology"],
        "Zoology": ["animal biology", "zoological research", "animal science"],
        "Other": ["others", "other area", "other field"],
    },
    "sample_size": {
        "Single Subject / Case Study": ["single subject", "single case", "case study", "case report", "one patient", "one subject", "one case", "n 1", "single patient", "single participant"],
        "Small Cohort (<50 subjects)": ["small cohort", "small group", "small sample", "< 50", "<50 subjects", "under 50", "fewer than 50", "less than 50", "below 50", "below fifty", "under fifty", "fewer than fifty"],
        "Medium Cohort (50-1000 subjects)": ["medium cohort", "medium group", "mid size cohort", "medium sized cohort", "medium sample", "50 1000", "50 to 1000", "between 50 and 1000"],
        "Large Cohort / Population-scale (>1000 subjects)": ["large cohort", "large group", "population scale", "population based", "> 1000", ">1000 subjects", "over 1000", "more than 1000", "above 1000", "large sample", "thousands of subjects"],
        "Relies on Cell/Animal Replicates": ["replicates", "cell replicates", "animal replicates", "cell animal replicates", "biological replicates", "technical replicates", "replicates cells animals"],
        "Not Specified / Not Applicable": ["not specified", "unspecified", "not applicable", "not stated", "not reported", "not given", "size not given", "not mentioned"],
    },
}

#: Numbers of subjects that the categories of sample_size stand for.
SIZE_BINS = {
    "sample_size": [
        (1, 1, "Single Subject / Case Study"),
        (2, 49, "Small Cohort (<50 subjects)"),
        (50, 1000, "Medium Cohort (50-1000 subjects)"),
        (1001, float("inf"), "Large Cohort / Population-scale (>1000 subjects)"),
    ]
}

#: Words that may stand around a name without changing what it means.
FILLERS = frozenset(
    "a the of in and dept department applied area topics general related research group field studies study science sciences model models mostly mainly "
    "primarily adult juvenile wild type strain set both sexes laboratory lab probably approx approximately about size primary material only sp cf".split()
)
