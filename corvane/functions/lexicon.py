"""Lexicons of methods, data sets, contributions, novelty, sections and in-text mentions.

Patterns are matched without regard to case, methods and the like against lower-cased text. Larger vocabularies (filter
words, synonyms) are parameters of the operators; see ``vocabulary``.
"""

from __future__ import annotations

# Fixed values from here on: they must equal the published lexicons for equal results.

METHODS = {
    "transformer": r"\btransformers?\b",
    "attention": r"\b(?:self-)?attention\b",
    "cnn": r"\b(?:cnn|convolutional neural network)s?\b",
    "rnn": r"\b(?:rnn|recurrent neural network|lstm|gru)s?\b",
    "gan": r"\b(?:gan|generative adversarial)s?\b",
    "vae": r"\b(?:vae|variational auto-?encoder)s?\b",
    "diffusion": r"\bdiffusion (?:model|process)s?\b",
    "autoencoder": r"\bauto-?encoders?\b",
    "mlp": r"\b(?:mlp|multi-?layer perceptron)s?\b",
    "graph_neural_network": r"\b(?:gnn|graph neural network|gcn|graph convolutional)s?\b",
    "neural_network": r"\bneural networks?\b",
    "reinforcement_learning": r"\breinforcement learning\b",
    "supervised_learning": r"\bsupervised learning\b",
    "unsupervised_learning": r"\bunsupervised learning\b",
    "self_supervised": r"\bself-?supervised\b",
    "contrastive_learning": r"\bcontrastive learning\b",
    "meta_learning": r"\bmeta-?learning\b",
    "transfer_learning": r"\btransfer learning\b",
    "federated_learning": r"\bfederated learning\b",
    "active_learning": r"\bactive learning\b",
    "online_learning": r"\bonline learning\b",
    "few_shot": r"\bfew-?shot\b",
    "zero_shot": r"\bzero-?shot\b",
    "multi_task": r"\bmulti-?task\b",
    "curriculum_learning": r"\bcurriculum learning\b",
    "fine_tuning": r"\bfine-?tun(?:e|ing)\b",
    "pre_training": r"\bpre-?train(?:ed|ing)?\b",
    "prompting": r"\bprompt(?:ing|s)?\b",
    "in_context_learning": r"\bin-?context learning\b",
    "chain_of_thought": r"\bchain-?of-?thought\b",
    "rlhf": r"\b(?:rlhf|reinforcement learning (?:from|with) human feedback)\b",
    "distillation": r"\b(?:knowledge )?distillation\b",
    "pruning": r"\bpruning\b",
    "quantization": r"\bquantization\b",
    "dropout": r"\bdropout\b",
    "batch_normalization": r"\bbatch normali[sz]ation\b",
    "layer_normalization": r"\blayer normali[sz]ation\b",
    "regularization": r"\bregulari[sz]ation\b",
    "data_augmentation": r"\bdata augmentation\b",
    "ensemble": r"\bensemble\b",
    "bagging": r"\bbagging\b",
    "boosting": r"\bboosting\b",
    "cross_validation": r"\bcross-?validation\b",
    "adam": r"\badam\b",
    "sgd": r"\b(?:sgd|stochastic gradient descent)\b",
    "gradient_descent": r"\bgradient descent\b",
    "backpropagation": r"\bbackpropagation\b",
    "bert": r"\bbert\b",
    "gpt": r"\bgpt(?:-\d)?\b",
    "llm": r"\b(?:llm|large language model)s?\b",
    "word_embeddings": r"\bword (?:embeddings?|vectors?)\b",
    "tokenization": r"\btokeni[sz]ation\b",
    "named_entity_recognition": r"\b(?:ner|named entity recognition)\b",
    "sentiment_analysis": r"\bsentiment analysis\b",
    "machine_translation": r"\bmachine translation\b",
    "question_answering": r"\bquestion answering\b",
    "text_generation": r"\btext generation\b",
    "summarization": r"\bsummari[sz]ation\b",
    "object_detection": r"\bobject detection\b",
    "image_classification": r"\bimage classification\b",
    "semantic_segmentation": r"\bsemantic segmentation\b",
    "instance_segmentation": r"\binstance segmentation\b",
    "pose_estimation": r"\bpose estimation\b",
    "optical_flow": r"\boptical flow\b",
    "depth_estimation": r"\bdepth estimation\b",
    "image_generation": r"\bimage generation\b",
    "super_resolution": r"\bsuper-?resolution\b",
    "style_transfer": r"\bstyle transfer\b",
    "clustering": r"\bclustering\b",
    "dimensionality_reduction": r"\bdimensionality reduction\b",
    "anomaly_detection": r"\banomaly detection\b",
    "recommendation": r"\brecommend(?:ation|er)s?\b",
    "time_series": r"\btime series\b",
    "forecasting": r"\bforecast(?:ing)?\b",
    "random_forest": r"\brandom forest\b",
    "decision_tree": r"\bdecision trees?\b",
    "svm": r"\b(?:svm|support vector machine)s?\b",
    "logistic_regression": r"\blogistic regression\b",
    "linear_regression": r"\blinear regression\b",
    "naive_bayes": r"\bnaive bayes\b",
    "knn": r"\b(?:knn|k-?nearest neighbor)s?\b",
    "pca": r"\b(?:pca|principal component analysis)\b",
    "bayesian": r"\bbayesian\b",
    "monte_carlo": r"\bmonte carlo\b",
    "markov": r"\bmarkov\b",
}

DATASETS = {
    "imagenet": r"\bimagenet\b",
    "cifar": r"\bcifar-?(?:10|100)?\b",
    "mnist": r"\bmnist\b",
    "coco": r"\b(?:ms-?)?coco\b",
    "pascal_voc": r"\bpascal voc\b",
    "cityscapes": r"\bcityscapes\b",
    "ade20k": r"\bade20k\b",
    "celeba": r"\bceleb-?a\b",
    "lfw": r"\blfw\b",
    "kinetics": r"\bkinetics(?:-\d+)?\b",
    "youtube": r"\byoutube-?\d*[mk]?\b",
    "glue": r"\bglue\b",
    "superglue": r"\bsuperglue\b",
    "squad": r"\bsquad(?:\s*[12]\.?\d*)?\b",
    "wikitext": r"\bwikitext(?:-\d+)?\b",
    "wikipedia": r"\bwikipedia\b",
    "common_crawl": r"\bcommon crawl\b",
    "openwebtext": r"\bopenwebtext\b",
    "bookcorpus": r"\bbookcorpus\b",
    "pile": r"\bthe pile\b",
    "c4": r"\bc4\b",
    "lambada": r"\blambada\b",
    "hellaswag": r"\bhellaswag\b",
    "mmlu": r"\bmmlu\b",
    "humaneval": r"\bhumaneval\b",
    "gsm8k": r"\bgsm-?8k\b",
    "math": r"\bmath\b",
    "laion": r"\blaion(?:-\d+[bmk])?\b",
    "conceptual_captions": r"\bconceptual captions\b",
    "visual_genome": r"\bvisual genome\b",
    "flickr": r"\bflickr(?:\d+k)?\b",
    "librispeech": r"\blibrispeech\b",
    "audioset": r"\baudioset\b",
    "voxceleb": r"\bvoxceleb\b",
    "ogb": r"\bogb\b",
    "planetoid": r"\bplanetoid\b",
    "cora": r"\bcora\b",
    "citeseer": r"\bciteseer\b",
    "pubmed": r"\bpubmed\b",
    "atari": r"\batari\b",
    "mujoco": r"\bmujoco\b",
    "openai_gym": r"\b(?:openai )?gym\b",
    "dmc": r"\bdm control\b",
}

CONTRIBUTIONS = {
    "new_method": [
        r"\bwe propose\b", r"\bwe introduce\b", r"\bwe present\b",
        r"\bnovel (?:method|approach|algorithm|framework|architecture|model|technique)\b",
        r"\bnew (?:method|approach|algorithm|framework|architecture|model|technique)\b",
    ],
    "new_dataset": [
        r"\bwe (?:introduce|release|present|create|construct|build) (?:a )?(?:new )?dataset\b",
        r"\bnew benchmark\b", r"\bnovel dataset\b",
        r"\bdataset (?:consisting|containing|comprising)\b",
    ],
    "empirical_study": [
        r"\bempirical (?:study|analysis|evaluation|investigation)\b",
        r"\bwe (?:study|analyze|investigate|examine|evaluate)\b",
        r"\bcomparative (?:study|analysis)\b",
        r"\bablation stud(?:y|ies)\b",
    ],
    "theoretical": [
        r"\btheoretical (?:analysis|framework|foundation|guarantee|bound)\b",
        r"\bwe prove\b", r"\bwe show that\b", r"\btheorem\b",
        r"\bconvergence (?:analysis|guarantee|proof)\b",
    ],
    "survey": [
        r"\bsurvey\b", r"\breview\b", r"\boverview\b", r"\btutorial\b",
        r"\bcomprehensive (?:study|analysis|review)\b",
        r"\bstate-?of-?the-?art\b.*\breview\b",
    ],
    "application": [
        r"\bapplication (?:of|to)\b", r"\bapplied to\b",
        r"\breal-?world\b", r"\bpractical\b", r"\bcase study\b",
        r"\bdeployment\b", r"\bproduction\b",
    ],
    "improvement": [
        r"\bimprove(?:s|d|ment)?\b", r"\boutperform\b", r"\bstate-?of-?the-?art\b",
        r"\bachieve(?:s|d)? (?:new )?(?:state-?of-?the-?art|sota)\b",
        r"\bbeat(?:s|ing)?\b", r"\bsurpass\b",
    ],
    "analysis": [
        r"\bunderstanding\b", r"\binterpretab(?:le|ility)\b", r"\bexplainab(?:le|ility)\b",
        r"\bvisuali[sz](?:e|ation)\b", r"\binsight\b",
    ],
    "efficiency": [
        r"\befficient\b", r"\bfast(?:er)?\b", r"\blightweight\b",
        r"\bscalable\b", r"\bspeed-?up\b", r"\baccelerat\b",
        r"\breduc(?:e|ing|tion) (?:computation|memory|cost)\b",
    ],
    "robustness": [
        r"\brobust(?:ness)?\b", r"\badversarial\b", r"\bout-?of-?distribution\b",
        r"\bgenerali[sz](?:e|ation)\b", r"\btransfer(?:ability)?\b",
    ],
}

NOVELTY = [
    r"\bfirst\b.*\bto\b", r"\bfirst time\b", r"\bfor the first time\b",
    r"\bnovel\b", r"\bnew\b", r"\bunprecedented\b",
    r"\bstate-?of-?the-?art\b", r"\bsota\b",
    r"\boutperform(?:s|ing)?\b", r"\bsurpass(?:es|ing)?\b",
    r"\bsignificant(?:ly)? (?:improve|better|outperform)\b",
]

SECTIONS = {
    "abstract": [
        r"^#{0,2}\s*(?:Abstract|ABSTRACT)\s*$",
        r"^(?:\d+\.?\s*)?(?:Abstract|ABSTRACT)\s*$",
    ],
    "introduction": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Introduction|INTRODUCTION)\s*$",
        r"^(?:\d+\.?\s*)?(?:Introduction|INTRODUCTION)\s*$",
        r"^I\.\s*(?:Introduction|INTRODUCTION)\s*$",
    ],
    "related_work": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Related\s+Work|RELATED\s+WORK|Background|BACKGROUND|Prior\s+Work|PRIOR\s+WORK)\s*$",
        r"^(?:\d+\.?\s*)?(?:Related\s+Work|RELATED\s+WORK|Background|BACKGROUND|Literature\s+Review|LITERATURE\s+REVIEW)\s*$",
        r"^II\.\s*(?:Related\s+Work|Background)\s*$",
    ],
    "methods": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Method(?:s|ology)?|METHOD(?:S|OLOGY)?|Approach|APPROACH|Model|MODEL|Framework|FRAMEWORK)\s*$",
        r"^(?:\d+\.?\s*)?(?:Method(?:s|ology)?|METHOD(?:S|OLOGY)?|Proposed\s+(?:Method|Approach)|Our\s+(?:Method|Approach))\s*$",
        r"^III\.\s*(?:Method(?:s|ology)?|Approach|Model)\s*$",
        r"^(?:\d+\.?\s*)?(?:Technical\s+Approach|TECHNICAL\s+APPROACH)\s*$",
    ],
    "experiments": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Experiment(?:s|al)?(?:\s+(?:Results?|Setup|Settings?))?|EXPERIMENT(?:S|AL)?)\s*$",
        r"^(?:\d+\.?\s*)?(?:Experiment(?:s|al)?|Evaluation|EVALUATION|Results?\s+and\s+(?:Analysis|Discussion))\s*$",
        r"^IV\.\s*(?:Experiment(?:s)?|Evaluation)\s*$",
        r"^(?:\d+\.?\s*)?(?:Empirical\s+(?:Study|Evaluation)|EMPIRICAL\s+(?:STUDY|EVALUATION))\s*$",
    ],
    "results": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Results?|RESULTS?)\s*$",
        r"^(?:\d+\.?\s*)?(?:Results?\s*(?:and\s+(?:Analysis|Discussion))?)\s*$",
        r"^V\.\s*(?:Results?)\s*$",
        r"^(?:\d+\.?\s*)?(?:Main\s+Results?|MAIN\s+RESULTS?)\s*$",
    ],
    "discussion": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Discussion|DISCUSSION)\s*$",
        r"^(?:\d+\.?\s*)?(?:Discussion|Analysis|ANALYSIS)\s*$",
        r"^VI\.\s*(?:Discussion)\s*$",
    ],
    "limitations": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Limitation(?:s)?|LIMITATION(?:S)?)\s*$",
        r"^(?:\d+\.?\d*\.?\s*)?(?:Limitation(?:s)?|LIMITATION(?:S)?)\s*$",
        r"^(?:\d+\.?\s*)?(?:Limitation(?:s)?\s+and\s+Future\s+Work)\s*$",
        r"^(?:Limitation(?:s)?\s+of\s+(?:Our|This|the)\s+(?:Work|Study|Approach|Method))\s*$",
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Threats\s+to\s+Validity|THREATS\s+TO\s+VALIDITY)\s*$",
    ],
    "future_work": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Future\s+Work|FUTURE\s+WORK|Future\s+Directions?|FUTURE\s+DIRECTIONS?)\s*$",
        r"^(?:\d+\.?\d*\.?\s*)?(?:Future\s+Work|FUTURE\s+WORK)\s*$",
        r"^(?:\d+\.?\s*)?(?:Future\s+Research\s+Directions?)\s*$",
        r"^(?:Open\s+(?:Problems?|Questions?)|OPEN\s+(?:PROBLEMS?|QUESTIONS?))\s*$",
    ],
    "conclusion": [
        r"^#{0,2}\s*(?:\d+\.?\s*)?(?:Conclusion(?:s)?|CONCLUSION(?:S)?)\s*$",
        r"^(?:\d+\.?\s*)?(?:Conclusion(?:s)?|CONCLUSION(?:S)?|Summary|SUMMARY)\s*$",
        r"^(?:VII|VIII|IX|X)\.\s*(?:Conclusion(?:s)?)\s*$",
        r"^(?:\d+\.?\s*)?(?:Concluding\s+Remarks?|CONCLUDING\s+REMARKS?)\s*$",
    ],
    "acknowledgments": [
        r"^#{0,2}\s*(?:Acknowledgment(?:s)?|ACKNOWLEDGMENT(?:S)?)\s*$",
        r"^(?:Acknowledgment(?:s)?|ACKNOWLEDGMENT(?:S)?)\s*$",
    ],
    "references": [
        r"^#{0,2}\s*(?:Reference(?:s)?|REFERENCE(?:S)?|Bibliography|BIBLIOGRAPHY)\s*$",
        r"^(?:Reference(?:s)?|REFERENCE(?:S)?)\s*$",
    ],
    "appendix": [
        r"^#{0,2}\s*(?:Appendix|APPENDIX|Appendices|APPENDICES)(?:\s+[A-Z])?\.?\s*$",
        r"^(?:Appendix|APPENDIX)(?:\s+[A-Z])?(?:\.|\:)?\s*",
        r"^(?:Supplementary\s+Material(?:s)?|SUPPLEMENTARY\s+MATERIAL(?:S)?)\s*$",
    ],
}

LIMITATION_MENTIONS = [
    r"(?:our|this|the)\s+(?:work|method|approach|model|study)\s+(?:has|have|is)\s+(?:several\s+)?(?:some\s+)?(?:limitations?|limited)",
    r"(?:one|a)\s+(?:key\s+)?limitation\s+(?:of|is)\s+",
    r"(?:we|our\s+work)\s+(?:do(?:es)?\s+not|cannot|fail(?:s)?\s+to)",
    r"(?:it\s+is|there\s+(?:is|are)|we\s+found)\s+(?:difficult|challenging|hard)\s+to",
    r"(?:however|unfortunately|admittedly),?\s+(?:our|this|the)\s+(?:method|approach|model)",
    r"(?:this\s+)?(?:approach|method|model)\s+(?:struggles?|fails?)\s+(?:with|to|when)",
    r"(?:does\s+not\s+(?:generalize|scale|work)\s+well)",
    r"(?:is\s+(?:not\s+(?:able|designed|intended)|limited)\s+to)",
    r"(?:remains?\s+(?:a|an)\s+(?:open|unsolved|challenging)\s+(?:problem|question|issue))",
    r"(?:require(?:s|d)?\s+(?:further|additional|more)\s+(?:research|investigation|study))",
]

FUTURE_MENTIONS = [
    r"(?:in\s+)?(?:the\s+)?future(?:\s+work)?(?:,)?\s+(?:we|it|one)\s+(?:will|would|could|should|plan\s+to|aim\s+to|intend\s+to)",
    r"(?:we|it)\s+(?:leave|defer|postpone)\s+(?:this|it|these)\s+(?:for|to)\s+future\s+(?:work|research|study)",
    r"(?:an?\s+)?(?:interesting|promising|natural|important)\s+(?:direction|avenue|extension|area)\s+(?:for\s+future\s+(?:work|research)|would\s+be)",
    r"(?:we\s+plan\s+to|we\s+will|we\s+aim\s+to|we\s+intend\s+to)\s+(?:extend|explore|investigate|study|address)",
    r"(?:it\s+would\s+be\s+(?:interesting|valuable|worthwhile)\s+to)",
    r"(?:further\s+(?:research|investigation|study)\s+(?:is\s+needed|should|could))",
    r"(?:open\s+(?:questions?|problems?|issues?)\s+(?:include|remain|are))",
    r"(?:remains?\s+to\s+be\s+(?:seen|explored|investigated|studied))",
]

LIMITATION_THEMES = {
    "scalability": r"\b(?:scal(?:e|ability|ing)|large-?scale|computational cost|memory|efficiency)\b",
    "generalization": r"\b(?:generali[sz](?:e|ation)|domain|transfer|out-of-distribution|ood)\b",
    "data_requirements": r"\b(?:data|labeled|annotation|training (?:data|examples)|sample(?:s)?)\b",
    "assumptions": r"\b(?:assum(?:e|ption|ing)|require(?:s|ment)?|condition|constraint)\b",
    "evaluation": r"\b(?:evaluat(?:e|ion)|benchmark|metric|dataset|test(?:ing)?)\b",
    "theoretical": r"\b(?:theoretic(?:al)?|formal|proof|guarantee|bound)\b",
    "implementation": r"\b(?:implement(?:ation)?|engineering|practical|deploy(?:ment)?)\b",
    "interpretability": r"\b(?:interpret(?:ability)?|explain(?:ability)?|understand(?:ing)?|black-?box)\b",
    "bias_fairness": r"\b(?:bias|fair(?:ness)?|ethical|discriminat(?:e|ion))\b",
    "robustness": r"\b(?:robust(?:ness)?|adversarial|attack|noise|perturbation)\b",
}

DIRECTIONS = [
    r"(?:we\s+)?(?:plan|aim|intend|hope)\s+to",
    r"(?:would\s+be\s+)?(?:interesting|valuable|worthwhile)\s+to",
    r"future\s+(?:work|research)\s+(?:could|should|will|may)",
    r"(?:an?\s+)?(?:natural|promising|interesting)\s+(?:direction|extension)",
    r"remains?\s+(?:to\s+be|an?\s+open)",
    r"(?:further|additional)\s+(?:research|investigation|study)",
]

METHOD_FAMILIES = [
    r'\b(transformer|attention|bert|gpt|llm|language model)\b',
    r'\b(cnn|convolutional|resnet|vgg|inception)\b',
    r'\b(rnn|lstm|gru|recurrent)\b',
    r'\b(gan|generative adversarial|diffusion)\b',
    r'\b(reinforcement learning|rl|policy gradient|q-learning)\b',
    r'\b(graph neural|gnn|gcn|message passing)\b',
    r'\b(self-supervised|contrastive learning|siamese)\b',
    r'\b(fine-tuning|transfer learning|pre-training)\b',
    r'\b(neural network|deep learning|machine learning)\b',
    r'\b(monte carlo|mcmc|bayesian)\b',
]

DATASET_FAMILIES = [
    r'\b(imagenet|coco|cifar|mnist)\b',
    r'\b(squad|glue|superglue|mnli)\b',
    r'\b(wikitext|c4|pile|common crawl)\b',
    r'\b(openwebtext|bookcorpus|wikipedia)\b',
]

SIMPLE_STOP_WORDS = [
    'that', 'this', 'with', 'from', 'have', 'been', 'which', 'their',
    'more', 'will', 'also', 'such', 'than', 'into', 'these', 'other',
    'some', 'only', 'based', 'using', 'paper', 'method', 'approach',
    'results', 'propose', 'proposed', 'show', 'shown', 'model', 'models',
]

TOP_VENUES = [
    "neurips", "icml", "iclr", "cvpr", "iccv", "eccv", "acl", "emnlp", "naacl",
    "aaai", "ijcai", "kdd", "www", "sigir", "chi", "uist", "nature", "science",
]

VENUE_MENTIONS = [
    r"accepted\s+(?:at|to|by|in)\s+([A-Z][A-Za-z0-9\s\-\']+(?:\s+\d{4})?)",
    r"to\s+appear\s+(?:at|in)\s+([A-Z][A-Za-z0-9\s\-\']+(?:\s+\d{4})?)",
    r"published\s+(?:at|in)\s+([A-Z][A-Za-z0-9\s\-\']+(?:\s+\d{4})?)",
]
ALGORITHM_MENTIONS = [
    r"Algorithm\s+\d+",
    r"(?:we\s+use|using|employ)\s+(?:the\s+)?([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+algorithm",
    r"(?:SGD|Adam|AdamW|RMSprop|Momentum)",
]

HYPERPARAMETERS = [
    r"learning\s+rate\s+(?:of\s+)?([0-9.e\-]+)",
    r"batch\s+size\s+(?:of\s+)?(\d+)",
    r"(?:trained\s+for\s+)?(\d+)\s+epochs?",
    r"dropout\s+(?:rate\s+)?(?:of\s+)?([0-9.]+)",
    r"weight\s+decay\s+(?:of\s+)?([0-9.e\-]+)",
    r"hidden\s+(?:dimension|size)\s+(?:of\s+)?(\d+)",
    r"(\d+)\s+(?:attention\s+)?heads?",
    r"(\d+)\s+(?:transformer\s+)?layers?",
]

MODEL_COMPONENTS = r"(?:encoder|decoder|attention|transformer|embedding|layer|module|block|head)"

TRAINING_MENTIONS = [
    r"(?:trained|fine-tuned?)\s+(?:on|using|with)\s+([^.]+)",
    r"(?:GPU|TPU)s?\s+(?:with\s+)?(\d+\s*GB)?",
    r"training\s+(?:took|required)\s+([^.]+)",
]

OPPORTUNITY_LABELS = [
    "Hot topic needs survey", "Growing area needs implementations", "Rapidly emerging field",
    "Niche with high impact potential", "Established area",
]
# End of the fixed values.


def vocabulary(path: str) -> dict:
    """Filter words or synonyms from a YAML file of groups: {group: [word]} or {group: {canonical: [variant]}}."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def filter_words(vocab: dict) -> list[str]:
    """All words of the groups of a filter vocabulary, but its patterns."""
    return sorted({str(w).lower() for k, g in vocab.items() if k != "filter_patterns" for w in g or []})


def synonyms(vocab: dict) -> dict[str, str]:
    """variant -> canonical, the canonical itself included; of clashes the last in file order wins."""
    out: dict[str, str] = {}
    for group in vocab.values():
        for canonical, variants in (group or {}).items():
            out[str(canonical).lower()] = str(canonical)
            out |= {str(v).lower(): str(canonical) for v in variants or []}
    return out
